"""Versioned tables, SQL sessions, key-value commands, replication and users."""

import uuid

import pytest

from tidemark.auth import AuthError, Users
from tidemark.session import Session, split_top
from tidemark.sources.kv import KeyValue
from tidemark.sources.store import Conflict, Store, StoreError
from tidemark.streaming import replication

USERS = [(1, "Alice", 30, "New York"), (2, "Bob", 25, "London"), (3, "Carol", 35, "New York"), (4, "Dave", 28, "Tokyo"), (5, "Eve", 22, "London")]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


@pytest.fixture
def people(spark, root):
    s = Session(Store(spark, root))
    assert s.execute("CREATE TABLE users (id INT, name TEXT, age INTEGER, city TEXT)").message == "table users created"
    values = ", ".join(f"({i}, '{n}', {a}, '{c}')" for i, n, a, c in USERS)
    assert s.execute(f"INSERT INTO users (id, name, age, city) VALUES {values}").count == 5
    return s


def got(s, sql):
    r = s.execute(sql)
    assert r.rows is not None, r.message
    return [tuple(x) for x in r.rows.collect()]


def test_select(people):
    assert sorted(got(people, "SELECT name, age FROM users WHERE city = 'New York'")) == [("Alice", 30), ("Carol", 35)]
    assert sorted(got(people, "SELECT name FROM users WHERE age >= 28 AND city != 'Tokyo'")) == [("Alice",), ("Carol",)]
    assert sorted(got(people, "SELECT name FROM users WHERE NOT age > 28")) == [("Bob",), ("Dave",), ("Eve",)]
    assert got(people, "SELECT name, age FROM users ORDER BY age ASC LIMIT 3") == [("Eve", 22), ("Bob", 25), ("Dave", 28)]
    assert sorted(got(people, "SELECT name FROM users WHERE name LIKE '%a%'")) == [("Carol",), ("Dave",)]
    assert got(people, "SELECT city, count(*) AS n FROM users GROUP BY city ORDER BY n DESC, city") == [("London", 2), ("New York", 2), ("Tokyo", 1)]
    assert people.execute("SELECT name FROM users WHERE id = 1").render() == "name\nAlice\n(1 rows)"


def test_errors(people):
    for sql in ("SELECT * FROM nonexistent", "INSERT INTO users (id, bad) VALUES (9, 'x')", "SELECT missing FROM users", "SELECT * FROM users LIMIT -1", "NONSENSE", "COMMIT", "ROLLBACK", "DROP TABLE nope", "CREATE TABLE users (id INT)", "CREATE TABLE t (id BLOB)", "CREATE INDEX i ON users(nope)", "DROP INDEX nope", "INSERT INTO users (id) VALUES ('x')", "UPDATE users SET nope = 1"):
        assert people.execute(sql).message.startswith("ERROR: "), sql
    assert people.execute("INSERT INTO users (id, name) VALUES (1, 'again')").message == "ERROR: duplicate primary key: 1"
    assert people.execute("INSERT INTO users (id) VALUES (8), (8)").message == "ERROR: duplicate primary key: 8"
    assert people.execute("INSERT INTO users (name) VALUES ('nobody')").message == "ERROR: primary key is null"
    assert len(got(people, "SELECT * FROM users")) == 5


def test_update_delete_drop(people):
    assert people.execute("UPDATE users SET city = 'San, (Francisco' WHERE name = 'Bob'").message == "1 row updated"
    assert got(people, "SELECT city FROM users WHERE id = 2") == [("San, (Francisco",)]
    assert people.execute("DELETE FROM users WHERE age < 25").count == 1
    assert people.execute("INSERT INTO users (id, name) VALUES (5, 'Eve again')").count == 1
    assert got(people, "SELECT name, age FROM users WHERE id = 5") == [("Eve again", None)]
    assert people.execute("UPDATE users SET id = id + 100 WHERE id = 3").count == 1
    assert sorted(x[0] for x in got(people, "SELECT id FROM users")) == [1, 2, 4, 5, 103]
    assert people.execute("UPDATE users SET id = 1 WHERE id = 2").message == "ERROR: duplicate primary key: 1"
    assert sorted(x[0] for x in got(people, "SELECT id FROM users")) == [1, 2, 4, 5, 103]
    assert people.execute("DROP TABLE users").count == 5
    assert got(people, "SHOW TABLES") == []


def test_snapshot_isolation_of_two_sessions(spark, root):
    a, b = Session(Store(spark, root)), Session(Store(spark, root))
    a.execute("CREATE TABLE nums (id INT, n INT)")
    a.execute("INSERT INTO nums (id, n) VALUES (1, 5), (2, 100), (3, 9)")
    assert a.execute("CREATE INDEX idx_n ON nums(n)").count == 3
    assert [tuple(r) for r in a.execute("SHOW INDEXES").rows.collect()] == [("idx_n", "nums", "n")] and a.execute("SHOW INDEXES ON nums").count == 1 and a.execute("SHOW INDEXES ON nope").message.startswith("ERROR")
    assert got(a, "SELECT * FROM nums WHERE n > 9") == [(2, 100)]
    assert a.execute("EXPLAIN SELECT * FROM nums WHERE n > 9").message.startswith("-- plan: full-scan")
    a.store.compact("nums")
    assert a.execute("EXPLAIN SELECT * FROM nums WHERE n > 9").message.startswith("-- plan: index-scan on n (idx_n)")
    assert got(a, "SELECT * FROM nums WHERE n > 9") == [(2, 100)] and a.store.purge(0) > 0 and len(got(a, "SELECT * FROM nums")) == 3
    assert a.execute("BEGIN").message == "BEGIN"
    assert a.execute("BEGIN").message.startswith("ERROR")
    assert sorted(got(a, "SELECT id FROM nums")) == [(1,), (2,), (3,)]
    assert b.execute("INSERT INTO nums (id, n) VALUES (4, 7)").count == 1
    assert sorted(got(a, "SELECT id FROM nums")) == [(1,), (2,), (3,)]
    a.execute("COMMIT")
    assert sorted(got(a, "SELECT id FROM nums")) == [(1,), (2,), (3,), (4,)]


def test_first_committer_wins_and_own_writes_are_seen(spark, root):
    a, b = Session(Store(spark, root)), Session(Store(spark, root))
    a.execute("CREATE TABLE t (k TEXT, v INT)")
    a.execute("INSERT INTO t (k, v) VALUES ('alice', 1000), ('bob', 500)")
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE t SET v = 1 WHERE k = 'alice'")
    a.execute("DELETE FROM t WHERE k = 'bob'")
    a.execute("INSERT INTO t (k, v) VALUES ('carl', 7)")
    assert sorted(got(a, "SELECT k, v FROM t")) == [("alice", 1), ("carl", 7)]
    b.execute("UPDATE t SET v = 2 WHERE k = 'alice'")
    assert a.execute("COMMIT").message == "COMMIT"
    assert "conflict" in b.execute("COMMIT").message
    assert sorted(got(b, "SELECT k, v FROM t")) == [("alice", 1), ("carl", 7)]
    b.execute("BEGIN")
    b.execute("UPDATE t SET v = 3 WHERE k = 'carl'")
    b.execute("ROLLBACK")
    assert sorted(got(b, "SELECT k, v FROM t")) == [("alice", 1), ("carl", 7)]


def test_time_travel_vacuum_and_conflict_after_compaction(spark, root):
    store = Store(spark, root)
    kv = KeyValue(store)
    frame = lambda *r: spark.createDataFrame(list(r), "key string, value string, is_deleted boolean")
    first = kv.write(frame(("alice", "1000", False), ("bob", "500", False)))
    kv.write(frame(("alice", "800", False), ("bob", "700", False)))
    kv.write(frame(("alice", "900", False)))
    late = store.begin()
    last = kv.write(frame(("alice", None, True)))
    at = lambda ts: {r.key: r.value for r in kv.live(ts).collect()}
    assert at(first) == {"alice": "1000", "bob": "500"} and at(first + 1) == {"alice": "800", "bob": "700"}
    assert at(last - 1) == {"alice": "900", "bob": "700"} and at(last) == {"bob": "700"}
    late.stage("kv", spark.createDataFrame([("alice", "1234", False)], "key string, value string, _is_deleted boolean"))
    assert store.compact("kv") > 0  # keeps what the open snapshot can see
    with pytest.raises(Conflict):
        late.commit()
    assert store.compact("kv") > 0
    assert at(store.refresh().ts) == {"bob": "700"}
    assert store.versions(store.refresh().tables["kv"]).count() == 1
    with pytest.raises(StoreError):
        kv.live(first)
    again = KeyValue(Store(spark, root))
    assert {r.key: r.value for r in again.live().collect()} == {"bob": "700"}


def test_rows_without_manifest_are_not_seen(spark, root):
    store = Store(spark, root)
    kv = KeyValue(store)
    kv.put("a", "1")
    lost = store.begin()
    lost.stage("kv", spark.createDataFrame([("c", "3", False)], "key string, value string, _is_deleted boolean"))
    assert [(r.key, r.value) for r in KeyValue(Store(spark, root)).live().collect()] == [("a", "1")]


def test_a_dead_writers_claim_is_repaired(spark, root, monkeypatch):
    import tidemark.sources.store as module

    monkeypatch.setattr(module, "CLAIM_S", 0.2)
    store = Store(spark, root)
    kv = KeyValue(store)
    store._fs.create(store._path(f"{store.root}/_commits/{store.refresh().ts + 1:020d}.claim"), False).close()
    with pytest.raises(StoreError):
        kv.put("a", "1")
    store.repair()
    kv.put("a", "1")
    assert kv.get("a") == "1"


def test_commands(spark, root):
    kv = KeyValue(Store(spark, root))
    for line in ("SET name Alice", "SET age 30", 'SET city "New York"', "SET country USA"):
        assert kv.execute(line).wire() == "OK"
    assert kv.execute("get name").wire() == "VALUE Alice"
    assert kv.execute("GET missing_key").wire() == "NOT_FOUND"
    assert kv.execute("SCAN c d").wire() == "ROW city New York\nROW country USA\nSCAN_END 2"
    assert kv.execute("FINDVAL A N").wire() == "ROW name Alice\nSCAN_END 1"
    assert kv.execute("DELETE age").wire() == "OK" and kv.execute("GET age").wire() == "NOT_FOUND" and kv.execute("DEL age").wire() == "OK"
    assert kv.execute("SET motto carpe diem").wire() == "OK" and kv.execute("GET motto").wire() == "VALUE carpe diem" and kv.execute("DELETE motto").status == "OK"
    assert kv.execute("QUIT now").wire() == "QUIT" and all(kv.execute(x).status == "ERROR" for x in ("SCAN z a", "FINDVAL z a", "SET 'a b' c", "SET a", "GET", "GET a b", "NOPE"))
    assert kv.execute("PING").wire() == "PONG" and kv.execute("HELP").value.startswith("SET <key> <value...> | GET <key>") and kv.execute("STATS").status == "VALUE" and kv.execute("STATS").value.startswith("keys=5 versions=")
    for bad in ("", "NOPE", "GET", 'SET "x'):
        assert kv.execute(bad).status == "ERROR"


def test_replication_resumes_without_loss_or_repeats(spark, tmp_path):
    log, replica, check = (f"{tmp_path}/{d}" for d in ("log", "replica", "check"))
    frame = lambda rows: spark.createDataFrame(rows, replication.SCHEMA)
    first = [(0, "SET", "user:1", "Alice"), (1, "SET", "user:2", "Bob"), (2, "SET", "config:version", "1")]
    frame(first).write.mode("append").parquet(log)
    replication.replicate(spark, log, replica, check).awaitTermination()
    assert replication.applied(spark, replica).count() == 3
    # The primary sends an entry again, then goes on.
    frame([first[2], (3, "DELETE", "user:2", None), (4, "SET", "user:3", "Carol"), (5, "BEGIN", None, None), (6, "SET", "user:9", "lost")]).write.mode("append").parquet(log)
    replication.replicate(spark, log, replica, check).awaitTermination()
    assert replication.applied(spark, replica).count() == 7
    assert {r.key: r.value for r in replication.state(spark, replica).collect()} == {"user:1": "Alice", "user:3": "Carol", "config:version": "1"}
    replication.replicate(spark, log, replica, check).awaitTermination()
    assert replication.applied(spark, replica).count() == 7


def test_users(spark, root):
    u = Users()
    u.add("root", "correct horse", "SUPERUSER")
    u.add("reader", "battery staple", "READ_ONLY")
    for bad in (("root", "another one", "SUPERUSER"), ("x", "short", "READ_ONLY"), ("y", "long enough", "KING")):
        with pytest.raises(AuthError):
            u.add(*bad)
    assert u.login("root", "correct horse") and not u.login("nobody", "x")
    assert not any(u.login("reader", "wrong") for _ in range(5))
    assert not u.login("reader", "battery staple") and not u.permitted("reader", "SELECT")
    u.unlock("reader")
    assert u.login("reader", "battery staple") and u.permitted("reader", "SELECT") and not u.permitted("reader", "INSERT")
    s = Session(Store(spark, root), allowed=lambda p: u.permitted("reader", p))
    assert s.execute("CREATE TABLE t (a INT)").message == "ERROR: permission denied: CREATE"


def test_split_top():
    assert split_top("a = 'x, y', b = f(1, 2)", ",") == ["a = 'x, y'", " b = f(1, 2)"]
    assert split_top("a = 'where' where b = 1", "WHERE") == ["a = 'where' ", " b = 1"]
    assert split_top("nowhere = 1", "WHERE") == ["nowhere = 1"]
