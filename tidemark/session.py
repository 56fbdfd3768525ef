"""SQL sessions over a Store. Catalyst parses and runs every SELECT; only what Spark can't run on Parquet is routed here."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from .sources.store import Conflict, Store, StoreError, Transaction

TYPES = {"INT": LongType(), "INTEGER": LongType(), "BIGINT": LongType(), "FLOAT": DoubleType(), "DOUBLE": DoubleType(), "TEXT": StringType(), "STRING": StringType(), "BOOL": BooleanType(), "BOOLEAN": BooleanType()}
_NAME = r"([A-Za-z_]\w*)"
_FORMS = {
    "begin": r"BEGIN(?:\s+TRANSACTION)?",
    "commit": r"COMMIT",
    "rollback": r"ROLLBACK",
    "show": r"SHOW\s+TABLES",
    "indexes": r"SHOW\s+INDEXES(?:\s+(?:ON|FROM)\s+(\w+))?",
    "create_table": rf"CREATE\s+TABLE\s+{_NAME}\s*\((.*)\)",
    "drop_table": rf"DROP\s+TABLE\s+{_NAME}",
    "create_index": rf"CREATE\s+INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\(\s*{_NAME}\s*\)",
    "drop_index": rf"DROP\s+INDEX\s+{_NAME}",
    "insert": rf"INSERT\s+INTO\s+{_NAME}\s*\(([^)]*)\)\s*(VALUES\b.*|SELECT\b.*)",
    "update": rf"UPDATE\s+{_NAME}\s+SET\s+(.*)",
    "delete": rf"DELETE\s+FROM\s+{_NAME}(?:\s+WHERE\s+(.*))?",
    "explain": r"EXPLAIN\s+(SELECT\b.*)",
    "select": r"(?:SELECT|WITH)\b.*",
}
_COMPILED = {k: re.compile(v, re.IGNORECASE | re.DOTALL) for k, v in _FORMS.items()}
PERMISSIONS = {"select": "SELECT", "explain": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "create_table": "CREATE", "create_index": "CREATE", "drop_table": "DROP", "drop_index": "DROP"}


@dataclass
class Result:
    message: str
    rows: DataFrame | None = None
    count: int = 0

    def render(self) -> str:
        """Column names, rows and their number as text; collects the rows."""
        if self.rows is None:
            return self.message
        found = self.rows.collect()
        lines = [" | ".join(self.rows.columns)] + [" | ".join("NULL" if v is None else str(v) for v in r) for r in found]
        return "\n".join([*lines, f"({len(found)} rows)"])


def split_top(text: str, at: str) -> list[str]:
    """text cut at a word or sign that stands outside of quotes and brackets."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    word = at.isalpha()
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and text[i : i + len(at)].upper() == at and not (word and (text[i - 1 : i].isalnum() or text[i + len(at) : i + len(at) + 1].isalnum())):
            out.append(text[last:i])
            last = i + len(at)
        i += 1
    return [*out, text[last:]]


class Session:
    """One client: statements commit by themselves unless between BEGIN and COMMIT. execute() returns errors as text."""

    def __init__(self, store: Store, allowed=None):
        self.spark = store.spark.newSession()
        self.store = Store(self.spark, store.root)
        self.store.open_reads = store.open_reads
        self.txn: Transaction | None = None
        #: Called with a permission before a statement; returns whether it is granted.
        self.allowed = allowed

    def execute(self, sql: str) -> Result:
        try:
            return self.run(sql)
        except Conflict as e:
            self.txn = None
            return Result(f"ERROR: {e}")
        except StoreError as e:
            return Result(f"ERROR: {e}")
        except PySparkException as e:
            return Result(f"ERROR: {str(e).splitlines()[0]}")

    def run(self, sql: str) -> Result:
        """Like execute(), but raises."""
        text = "\n".join(split_top(line, "--")[0] for line in sql.splitlines()).strip().rstrip(";").strip()
        for kind, form in _COMPILED.items():
            if m := form.fullmatch(text):
                break
        else:
            raise StoreError(f"syntax error near: {text[:40]}")
        if self.allowed and kind in PERMISSIONS and not self.allowed(PERMISSIONS[kind]):
            raise StoreError(f"permission denied: {PERMISSIONS[kind]}")
        if kind in ("begin", "commit", "rollback"):
            return getattr(self, f"_{kind}")()
        own = self.txn is None
        txn = self.store.begin() if own else self.txn
        try:
            out = getattr(self, f"_{kind}")(txn, *(m.groups() or (text,)))
            if own:
                txn.commit()
            return out
        except Exception:
            if own:
                txn.rollback()
            raise

    # ---------------------------------------------------------------------------------------- transactions
    def _begin(self) -> Result:
        if self.txn:
            raise StoreError("already in a transaction")
        self.txn = self.store.begin()
        return Result("BEGIN")

    def _commit(self) -> Result:
        if not self.txn:
            raise StoreError("no transaction to commit")
        txn, self.txn = self.txn, None
        txn.commit()
        return Result("COMMIT")

    def _rollback(self) -> Result:
        if not self.txn:
            raise StoreError("no transaction to roll back")
        txn, self.txn = self.txn, None
        txn.rollback()
        return Result("ROLLBACK")

    # -------------------------------------------------------------------------------------------------- DDL
    def _show(self, txn: Transaction, *_: str) -> Result:
        names = sorted(txn.catalog().tables)
        return Result("", self.spark.createDataFrame([(n,) for n in names], "table string"), len(names))

    def _indexes(self, txn: Transaction, table: str | None) -> Result:
        """Names, tables and columns of all indexes, or of a table's."""
        if table is not None:
            txn.table(table)
        found = [(i, t, c) for i, (t, c) in sorted(txn.catalog().indexes.items()) if table in (None, t)]
        return Result("", self.spark.createDataFrame(found, "index string, table string, column string"), len(found))

    def _create_table(self, txn: Transaction, name: str, body: str) -> Result:
        if name in txn.catalog().tables:
            raise StoreError(f"table {name} already exists")
        schema, seen = StructType(), set()
        for part in split_top(body, ","):
            words = part.split()
            if len(words) != 2 or words[1].upper() not in TYPES:
                raise StoreError(f"bad column: {part.strip()}")
            if words[0].lower() in seen or words[0].startswith("_"):
                raise StoreError(f"bad column name: {words[0]}")
            seen.add(words[0].lower())
            schema.add(words[0], TYPES[words[1].upper()])
        txn.change(op="create", table=name, schema=schema.jsonValue())
        return Result(f"table {name} created")

    def _drop_table(self, txn: Transaction, name: str) -> Result:
        rows = txn.scan(name).count()
        txn.change(op="drop", table=name)
        return Result(f"table {name} dropped ({rows} rows)", count=rows)

    def _create_index(self, txn: Transaction, index: str, table: str, column: str) -> Result:
        if index in txn.catalog().indexes:
            raise StoreError(f"index {index} already exists")
        if column not in txn.table(table).schema.fieldNames():
            raise StoreError(f"no such column: {column}")
        entries = txn.scan(table).count()
        txn.change(op="index", index=index, table=table, column=column)
        return Result(f"index {index} created ({entries} entries)", count=entries)

    def _drop_index(self, txn: Transaction, index: str) -> Result:
        if index not in txn.catalog().indexes:
            raise StoreError(f"no such index: {index}")
        txn.change(op="unindex", index=index)
        return Result(f"index {index} dropped")

    # -------------------------------------------------------------------------------------------------- DML
    def _views(self, txn: Transaction) -> None:
        """The snapshot's tables as views of this session; they are plans, and cost nothing until read."""
        for old in self.spark.catalog.listTables():
            if old.isTemporary and old.name not in txn.catalog().tables:
                self.spark.catalog.dropTempView(old.name)
        for name in txn.catalog().tables:
            txn.scan(name).createOrReplaceTempView(name)

    def _select(self, txn: Transaction, sql: str) -> Result:
        self._views(txn)
        return Result("", self.spark.sql(sql))

    def _explain(self, txn: Transaction, sql: str) -> Result:
        """The physical plan, after a line on which indexed columns its filters use."""
        df = self._select(txn, sql).rows
        plan = df._jdf.queryExecution().toString()
        used = sorted({f"{c} ({i})" for i, (t, c) in txn.catalog().indexes.items() if re.search(rf"PushedFilters: \[[^\]]*\b{c}\b", plan)})
        return Result(f"-- plan: {'index-scan on ' + ', '.join(used) if used else 'full-scan'}\n{plan}")

    def _insert(self, txn: Transaction, name: str, columns: str, source: str) -> Result:
        table = txn.table(name)
        names, given = table.schema.fieldNames(), [c.strip() for c in columns.split(",")]
        if bad := [c for c in given if c not in names]:
            raise StoreError(f"no such column: {bad[0]}")
        if len(set(given)) != len(given):
            raise StoreError("a column is given twice")
        if source[:6].upper() == "SELECT":
            self._views(txn)
            rows = self.spark.sql(source)
        else:
            rows = self.spark.sql(f"SELECT * FROM {source}")
        if len(rows.columns) != len(given):
            raise StoreError(f"{len(given)} columns but {len(rows.columns)} values")
        rows = rows.toDF(*given)
        typed = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
        # Rows are staged as they are; checks run on what was written, so a source is read once.
        new = txn.stage(name, rows.select(*typed).withColumn("_is_deleted", F.lit(False)))
        if new:
            self._check_keys(txn, name)
        return Result(f"{new} row{'s' * (new != 1)} inserted", count=new)

    def _check_keys(self, txn: Transaction, name: str) -> None:
        """Refuses the rows staged last if a key is null, repeats, or is in the table already."""
        op = txn.ops.pop()
        key = txn.table(name).key
        staged = self.store.spark.read.parquet(op["path"]).where("not _is_deleted").select(key)
        if staged.where(F.col(key).isNull()).first():
            raise StoreError("primary key is null")
        there = txn.scan(name).select(key)
        twice = staged.groupBy(key).count().where("count > 1").select(key).unionByName(staged.join(there, key, "left_semi"))
        if hit := twice.first():
            raise StoreError(f"duplicate primary key: {hit[0]}")
        txn.ops.append(op)

    def _where(self, rest: str) -> tuple[str, str | None]:
        head, *tail = split_top(rest, "WHERE")
        if len(tail) > 1:
            raise StoreError("syntax error near: WHERE")
        return head, tail[0] if tail else None

    def _update(self, txn: Transaction, name: str, rest: str) -> Result:
        table = txn.table(name)
        head, where = self._where(rest)
        new = {}
        for part in split_top(head, ","):
            column, eq, value = part.partition("=")
            if not eq or column.strip() not in table.schema.fieldNames():
                raise StoreError(f"bad assignment: {part.strip()}")
            new[column.strip()] = F.expr(value.strip()).cast(table.schema[column.strip()].dataType)
        hit = txn.scan(name)
        hit = hit.where(F.expr(where)) if where else hit
        changed = hit.select(*[new.get(c, F.col(c)).alias(c) for c in hit.columns]).withColumn("_is_deleted", F.lit(False))
        if table.key not in new:
            n = txn.stage(name, changed)
            return Result(f"{n} row{'s' * (n != 1)} updated", count=n)
        # A changed key is a deletion and an insertion; both are read from the state before.
        both = hit.withColumn("_is_deleted", F.lit(True)).unionByName(changed)
        n = txn.stage(name, both) // 2
        if n:
            written = self.store.spark.read.parquet(txn.ops[-1]["path"])
            del txn.ops[-1]
            gone = written.where("_is_deleted").drop("_txn", "_commit_ts")
            fresh = written.where("not _is_deleted").drop("_txn", "_commit_ts")
            txn.stage(name, gone)
            try:
                txn.stage(name, fresh)
                self._check_keys(txn, name)
            except StoreError:
                txn.ops.pop()
                raise
        return Result(f"{n} row{'s' * (n != 1)} updated", count=n)

    def _delete(self, txn: Transaction, name: str, where: str | None) -> Result:
        hit = txn.scan(name)
        hit = hit.where(F.expr(where)) if where else hit
        n = txn.stage(name, hit.withColumn("_is_deleted", F.lit(True)))
        return Result(f"{n} row{'s' * (n != 1)} deleted", count=n)
