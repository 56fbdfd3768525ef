"""Column functions: ring hashes, sortable encodings, checksums, ranges."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_hash(key: Column | str) -> Column:
    """Position on a ring of 2^32: the md5 of the key, modulo 2^32."""
    return F.conv(F.substring(F.md5(_text(key)), 25, 8), 16, 10).cast("long")


def ring_hash_signed(key: Column | str) -> Column:
    """Position on a signed 64-bit ring: the first eight bytes of the md5."""
    return F.conv(F.substring(F.md5(_text(key)), 1, 16), 16, -10).cast("long")


def modulo_placement(key: Column | str, nodes: int) -> Column:
    """The whole 128-bit md5 modulo the number of nodes, in four steps of 32 bits that each fit a long."""
    digest, out = F.md5(_text(key)), F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        out = (out * F.lit(2**32 % nodes) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % F.lit(nodes)
    return out


def sortable_int(value: Column | str) -> Column:
    """Sixteen hex digits whose text order is the order of signed 64-bit numbers."""
    v = F.col(value) if isinstance(value, str) else value
    return F.lower(F.lpad(F.hex(v.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def float_bits(value: Column | str) -> Column:
    """The 64 bits of a double, as a long: sign, exponent and mantissa are worked out in exact arithmetic."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size, tiny, inf = F.abs(v), F.lit(2.0**-1022), F.lit(float("inf"))
    guess = F.floor(F.log2(F.greatest(F.least(size, F.lit(1.7976931348623157e308)), tiny))).cast("int")
    # A logarithm may round over a power of two; such powers and their products are exact.
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).otherwise(F.when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess))
    # Scaled in two steps, as a power of two may have no inverse.
    half = F.shiftright(power, 1)
    mantissa = size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)
    normal = (power.cast("long") + 1023) * F.lit(2**52) + ((mantissa - 1.0) * F.lit(2.0**52)).cast("long")
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(size == inf, F.lit(0x7FF0 << 48)).when(size < tiny, small).otherwise(normal)
    negative = (v < 0) | (v.cast("string") == "-0.0")
    return F.when(negative, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)


def sortable_float(value: Column | str) -> Column:
    """Sixteen hex digits whose text order is the order of doubles: all bits of negative ones are flipped, the sign of others."""
    bits = float_bits(value)
    flipped = F.when(bits < 0, bits.bitwiseXOR(F.lit(-1))).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))
    return F.lower(F.lpad(F.hex(flipped), 16, "0"))


def sortable_text(value: Column | str) -> Column:
    """Text is its own code; null is empty."""
    return F.coalesce(_text(value), F.lit(""))


def row_encoding(*fields: Column | str) -> Column:
    """Fields as text, each after its length and a colon."""
    parts = [F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def checksum(text: Column | str) -> Column:
    """CRC32 of the UTF-8 bytes."""
    return F.crc32(F.encode(_text(text), "utf-8"))


def seeded_checksum(text: Column | str, seed: int) -> Column:
    """CRC32 that starts from a seed: that of the text after four bytes whose CRC32 is the seed."""
    data = F.encode(_text(text), "utf-8")
    return F.crc32(F.concat(F.lit(crc_prefix(seed)), data) if seed else data)


def crc_prefix(crc: int) -> bytes:
    """Four bytes with a given CRC32, which is affine in their bits: the linear part is solved by elimination."""
    base, basis = zlib.crc32(bytes(4)), {}
    for i in range(32):
        image, source = zlib.crc32((1 << i).to_bytes(4, "little")) ^ base, 1 << i
        while (high := image.bit_length()) in basis:
            image, source = image ^ basis[high][0], source ^ basis[high][1]
        basis[high] = image, source
    left, out = crc ^ base, 0
    while left:
        image, source = basis[left.bit_length()]
        left, out = left ^ image, out ^ source
    return out.to_bytes(4, "little")


#: Bits and hashes of the filter in a sorted file, and the step between its seeds; fixed values.
FILTER_BITS, FILTER_HASHES, FILTER_STEP = 10_000, 3, 0x9E3779B9


def filter_positions(key: Column | str, bits: int = FILTER_BITS, hashes: int = FILTER_HASHES) -> Column:
    """The bits that a key sets in a sorted file's Bloom filter."""
    return F.array(*[(seeded_checksum(key, i * FILTER_STEP & 0xFFFFFFFF) % bits) for i in range(hashes)])


def range_of(key: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are at most key. Cuts stand in blocks, so a row looks at twice their square root."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    count = lambda array: F.size(F.filter(array, lambda x: x <= key))
    before = count(F.array(*[b[0] for b in blocks]))
    within = F.element_at(F.array(*[F.array(*b) for b in blocks]), F.greatest(before, F.lit(1)))
    return F.when(before == 0, 0).otherwise((before - 1) * width + count(within))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")
