"""Counter-based random draws as column expressions.

A draw depends only on (seed, stream, row, slot), never on partitioning, task
order or retries, so generated tables are the same on one core and on a
thousand executors, and after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str | int


def joined(parts: Sequence[Part], sep: str) -> list[Column]:
    """Columns for the parts; constants that stand next to each other become one literal."""
    out: list[Column] = []
    for constant, run in groupby(parts, key=lambda p: not isinstance(p, Column)):
        out += [F.lit(sep.join(map(str, run)))] if constant else list(run)
    return out


def cat(*parts: Part) -> Column:
    """Concatenate strings, numbers and columns."""
    return F.concat(*joined(parts, ""))


def lines(*parts: Part) -> Column:
    """Join strings and arrays of strings with newlines."""
    return F.concat_ws("\n", *joined(parts, "\n"))


def listed(options: Sequence[str | int]) -> Column:
    """A constant array, made in one step."""
    return F.expr(f"array({', '.join(str(o) if isinstance(o, int) else quoted(o) for o in options)})")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column, most: int, body: Callable[[Column], Column]) -> Column:
    """``[body(0), ..., body(n-1)]`` for 0 <= n <= most."""
    return F.transform(F.slice(listed(range(most)), 1, n), body)


def digest(*key: Part) -> Column:
    """md5 of the key parts joined by ``|``: four 32-bit words in hex. Null parts are left out with their ``|``."""
    first, *rest = joined(key, "|")
    if isinstance(key[0], Column):  # it may be null, and what is left then begins without a ``|``
        return F.md5(F.concat_ws("|", first, *rest))
    # Plain concatenation takes half the time of concat_ws.
    return F.md5(F.concat(first, *[F.coalesce(F.concat(F.lit("|"), part.cast("string")), F.lit("")) for part in rest]))


def word(hexes: Column, number: Part = 0) -> Column:
    """One of the four words of a digest."""
    at = F.lit(number * 8 + 1) if isinstance(number, int) else number * 8 + 1
    return F.conv(F.substring(hexes, at, F.lit(8)), 16, 10).cast("bigint")


def u32(*key: Part) -> Column:
    """First word of the digest of the key."""
    return word(digest(*key))


class Draws:
    """Draws of one generated row; ``slot`` names the place the value goes to."""

    def __init__(self, seed: Part, stream: Part, row: Part):
        self.key = (seed, stream, row)

    def u32(self, *slot: Part) -> Column:
        return u32(*self.key, *slot)

    def below(self, n: Part, *slot: Part) -> Column:
        return (self.u32(*slot) % n).cast("int")

    def randint(self, low: int, high: int, *slot: Part) -> Column:
        return self.below(high - low + 1, *slot) + low

    def choice(self, options: Sequence[str | int], *slot: Part) -> Column:
        return F.get(listed(options), self.below(len(options), *slot))

    def choices(self, first: Sequence[str], second: Sequence[str], sep: str, *slot: Part) -> Column:
        """An entry of each list, both from one digest."""

        def both(hexes: Column) -> Column:
            places = [(word(hexes, i) % len(o)).cast("int") for i, o in enumerate((first, second))]
            return cat(F.get(listed(first), places[0]), sep, F.get(listed(second), places[1]))

        return let(digest(*self.key, *slot), both)

    def weighted(self, options: Sequence[tuple[str, int]], *slot: Part) -> Column:
        """Pick a name with the given integer weight."""
        point = self.below(sum(w for _, w in options), *slot)
        edge, picked = 0, None
        for name, weight in options[:-1]:
            edge += weight
            picked = F.when(point < edge, name) if picked is None else picked.when(point < edge, name)
        return picked.otherwise(options[-1][0])

    def sample(self, options: Sequence[str], k: Column, *slot: Part) -> Column:
        """``k`` options without replacement, in random order; a digest draws for four of them."""

        def shuffled(hexes: Column) -> Column:
            deck = F.transform(
                listed(options),
                lambda x, i: F.struct(word(F.get(hexes, F.floor(i / 4).cast("int")), i % 4).alias("d"), i.alias("i"), x.alias("x")),
            )
            return F.slice(F.sort_array(deck), 1, k)["x"]

        blocks = listed(range(-(-len(options) // 4)))
        return let(F.transform(blocks, lambda b: digest(*self.key, *slot, b)), shuffled)

    def two_of(self, options: Column, body: Callable[[Column, Column], Column], *slot: Part) -> Column:
        """``body`` of an ordered pair of different elements of an array of two or more."""

        def pair(hexes: Column) -> Column:
            n = F.size(options)
            first = (word(hexes) % n).cast("int")
            second = (first + 1 + (word(hexes, 1) % (n - 1)).cast("int")) % n
            return body(F.get(options, first), F.get(options, second))

        return let(digest(*self.key, *slot), pair)

    def hundredths(self, *slot: Part) -> Column:
        """A share in [0.02, 0.97] with two decimals; 1.00 can never be shown."""
        return cat("0.", F.lpad(self.randint(2, 97, *slot), 2, "0"))
