"""SQL text for the comparison queries: the key hash of short ASCII keys, after the published algorithm, and placement by it."""

from __future__ import annotations

# The first bytes of the hash's secret, and its primes and multipliers.
SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e")
PRIME_1, PRIME_2, PRIME_3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
MIX = 0x165667919E3779F9
_64 = 1 << 64


def _n(x: int) -> str:
    return f"{x}::uhugeint"


def _read(key: str, at: int, n: int, swap: bool = False) -> str:
    """The unsigned number of n bytes from the 1-based place ``at``, the first byte least, or first with ``swap``."""
    return "(" + " + ".join(f"ascii({key}[{at + i}])::uhugeint * {_n(256 ** (n - 1 - i if swap else i))}" for i in range(n)) + ")"


def _secret(at: int, n: int = 8) -> int:
    return int.from_bytes(SECRET[at : at + n], "little")


def _fold(a: str, b: str) -> str:
    """Upper and lower half of a product of two 64-bit numbers, one xor the other."""
    return f"xor(({a}) * ({b}) // {_n(_64)}, ({a}) * ({b}) % {_n(_64)})"


def _avalanche(x: str) -> str:
    y = f"(xor({x}, ({x}) // {_n(1 << 37)}) * {_n(MIX)} % {_n(_64)})"
    return f"xor({y}, {y} // {_n(1 << 32)})"


def hash_short(key: str, seed: str) -> str:
    """Of a string of two characters, with a seed below 2**16."""
    a, b = f"ascii({key}[1])::uhugeint", f"ascii({key}[2])::uhugeint"
    word = f"({a} * {_n(1 << 16)} + {b} * {_n(1 << 24)} + {b} + {_n(2 << 8)})"
    x = f"xor({word}, {_n(_secret(0, 4) ^ _secret(4, 4))} + {seed}::uhugeint)"
    x = f"(xor({x}, {x} // {_n(1 << 33)}) * {_n(PRIME_2)} % {_n(_64)})"
    x = f"(xor({x}, {x} // {_n(1 << 29)}) * {_n(PRIME_3)} % {_n(_64)})"
    return f"xor({x}, {x} // {_n(1 << 32)})"


def hash_16(key: str) -> str:
    """Of a string of sixteen characters."""
    flip = _secret(24) ^ _secret(32), _secret(40) ^ _secret(48)
    low, high = f"xor({_read(key, 1, 8)}, {_n(flip[0])})", f"xor({_read(key, 9, 8)}, {_n(flip[1])})"
    swapped = f"xor({_read(key, 1, 8, True)}, {_n(int.from_bytes(flip[0].to_bytes(8, 'little'), 'big'))})"
    return _avalanche(f"(({_n(16)} + {swapped} + {high} + {_fold(low, high)}) % {_n(_64)})")


def hash_17(key: str) -> str:
    """Of a string of seventeen characters."""
    word = lambda at, s: f"xor({_read(key, at, 8)}, {_n(_secret(s))})"
    first, last = _fold(word(1, 0), word(9, 8)), _fold(word(2, 16), word(10, 24))
    return _avalanche(f"(({_n(17 * PRIME_1 % _64)} + {first} + {last}) % {_n(_64)})")


def partition_sql(hashed: str) -> str:
    return f"({hashed} % {_n(4096)})::integer"


def placed_sql(nodes: list[tuple[str, str]], rf: int) -> str:
    """(partition, rank, node, zone): by score one node a zone, then the rest."""
    rows = ", ".join(f"('{n}', '{z}')" for n, z in nodes)
    return f"""(SELECT p AS partition, (r - 1)::integer AS rank, node, zone FROM (
      SELECT *, row_number() OVER (PARTITION BY p ORDER BY in_zone > 1, score DESC, node) AS r FROM (
      SELECT *, row_number() OVER (PARTITION BY p, zone ORDER BY score DESC, node) AS in_zone FROM (
      SELECT p::integer AS p, node, zone, {hash_short("node", "p")} AS score FROM range(4096) t(p), (VALUES {rows}) n(node, zone)))) WHERE r <= {rf})"""


def sets_sql(nodes: list[tuple[str, str]], rf: int) -> str:
    return f"(SELECT partition, list(node ORDER BY rank) AS replicas FROM {placed_sql(nodes, rf)} GROUP BY partition)"
