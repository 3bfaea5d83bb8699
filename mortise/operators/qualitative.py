"""Qualitative calculi: composition tables from models, networks of masks, path consistency."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortise.operators.loops import rounds, settled

#: The base relations of each calculus, in the order of their bits.
ALLEN = ("before", "meets", "overlaps", "starts", "during", "finishes", "intervalEqual", "finishedBy", "contains", "startedBy", "overlappedBy", "metBy", "after")
POINT = ("instantBefore", "instantEqual", "instantAfter")
RCC8 = ("spatiallyDisconnected", "externallyConnected", "partiallyOverlapping", "tangentialProperPart", "nonTangentialProperPart", "tangentialProperPartInverse", "nonTangentialProperPartInverse", "spatiallyEqual")
CARDINAL = ("southWestOf", "westOf", "northWestOf", "southOf", "sameLocationAs", "northOf", "southEastOf", "eastOf", "northEastOf")
RELATIVE = ("behindLeftOf", "leftOf", "frontLeftOf", "behind", "sameRelativePositionAs", "inFrontOf", "behindRightOf", "rightOf", "frontRightOf")
DISTANCE = ("coLocatedWith", "veryCloseTo", "closeTo", "nearTo", "moderatelyFarFrom", "farFrom", "veryFarFrom")
#: Upper bounds of the distance classes but the last.
DISTANCE_BOUNDS = (0, 1, 10, 100, 1000, 10000)
#: Derived relations as sets of base relations.
DERIVED = {
    "precedes": ("before", "meets"),
    "precededBy": ("after", "metBy"),
    "subintervalOf": ("starts", "during", "finishes", "intervalEqual"),
    "properSubintervalOf": ("starts", "during", "finishes"),
    "hasSubinterval": ("startedBy", "contains", "finishedBy", "intervalEqual"),
    "sharesTimeWith": ("overlaps", "overlappedBy", "starts", "startedBy", "during", "contains", "finishes", "finishedBy", "intervalEqual"),
    "temporallyDisjoint": ("before", "after", "meets", "metBy"),
    "instantNotAfter": ("instantBefore", "instantEqual"),
    "instantNotBefore": ("instantAfter", "instantEqual"),
    "instantNotEqual": ("instantBefore", "instantAfter"),
    "regionConnectedTo": RCC8[1:],
    "partOfRegion": ("tangentialProperPart", "nonTangentialProperPart", "spatiallyEqual"),
    "properPartOfRegion": ("tangentialProperPart", "nonTangentialProperPart"),
    "hasRegionPart": ("tangentialProperPartInverse", "nonTangentialProperPartInverse", "spatiallyEqual"),
    "regionOverlaps": RCC8[2:],
    "regionDiscreteFrom": ("spatiallyDisconnected", "externallyConnected"),
    "northwardOf": ("northWestOf", "northOf", "northEastOf"),
    "southwardOf": ("southWestOf", "southOf", "southEastOf"),
    "eastwardOf": ("southEastOf", "eastOf", "northEastOf"),
    "westwardOf": ("southWestOf", "westOf", "northWestOf"),
    "leftwardOf": ("behindLeftOf", "leftOf", "frontLeftOf"),
    "rightwardOf": ("behindRightOf", "rightOf", "frontRightOf"),
    "frontwardOf": ("frontLeftOf", "inFrontOf", "frontRightOf"),
    "rearwardOf": ("behindLeftOf", "behind", "behindRightOf"),
    "withinNearDistanceOf": DISTANCE[:4],
    "beyondFarDistanceFrom": DISTANCE[5:],
    "atSomeDistanceFrom": DISTANCE[1:],
}


def _sign(a: float, b: float) -> int:
    return (a > b) - (a < b)


def allen_of(i: tuple, j: tuple) -> str:
    """The base relation of two intervals (start, end) with start < end."""
    (a, b), (c, d) = i, j
    if b <= c:
        return "meets" if b == c else "before"
    if d <= a:
        return "metBy" if a == d else "after"
    at = {(0, 0): "intervalEqual", (0, -1): "starts", (0, 1): "startedBy", (1, 0): "finishes", (-1, 0): "finishedBy", (1, -1): "during", (-1, 1): "contains", (-1, -1): "overlaps", (1, 1): "overlappedBy"}
    return at[_sign(a, c), _sign(b, d)]


def _rcc_of(x: int, y: int) -> str:
    """The relation of two closed regions made of unit cells on a line, given as bit sets."""
    edge = lambda r: r | r << 1  # cell k has the points k and k + 1
    inner = lambda r: r & (r << 1)  # points inside a region
    if x == y:
        return "spatiallyEqual"
    if not x & y:
        return "externallyConnected" if edge(x) & edge(y) else "spatiallyDisconnected"
    if x & ~y and y & ~x:
        return "partiallyOverlapping"
    small, large = (x, y) if not x & ~y else (y, x)
    touches = edge(small) & edge(large) & ~inner(large)
    return ("tangentialProperPart" if touches else "nonTangentialProperPart") + ("" if small == x else "Inverse")


class Calculus:
    """Base relations with converse and composition, read off all triples of a set of models."""

    def __init__(self, names: tuple[str, ...], models: Iterable, relation: Callable[[object, object], str]):
        self.names, self.bit = names, {n: 1 << i for i, n in enumerate(names)}
        self.full = (1 << len(names)) - 1
        models = list(models)
        at = {(i, j): self.bit[relation(a, b)] for (i, a), (j, b) in product(enumerate(models), repeat=2)}
        self.converse_of = {r: at[j, i] for (i, j), r in at.items()}
        self.compose: dict[tuple[int, int], int] = {}
        n = range(len(models))
        for i, j in product(n, n):
            r = at[i, j]
            for k in n:
                key = (r, at[j, k])
                self.compose[key] = self.compose.get(key, 0) | at[i, k]

    def mask(self, *names: str) -> int:
        return sum(self.bit[b] for n in names for b in DERIVED.get(n, (n,)))

    def converse(self, mask: int) -> int:
        return sum(self.converse_of[b] for b in self.converse_of if b & mask)

    def named(self, column: str) -> Column:
        """A mask column as the sorted array of its names."""
        return F.array_sort(F.filter(F.array(*(F.when(F.col(column).bitwiseAND(b) != 0, F.lit(n)) for n, b in self.bit.items())), lambda x: x.isNotNull()))

    def table(self, spark) -> DataFrame:
        """(r1, r2, mask) for each pair of base relations, at most a few hundred rows."""
        return spark.createDataFrame([(a, b, m) for (a, b), m in self.compose.items()], "r1 int, r2 int, mask int")


@lru_cache(maxsize=8)
def calculus(name: str) -> Calculus:
    """allen, point, rcc8, cardinal, relative or distance."""
    if name == "allen":
        return Calculus(ALLEN, [(a, b) for a in range(6) for b in range(a + 1, 6)], allen_of)
    if name == "point":
        return Calculus(POINT, range(3), lambda a, b: POINT[_sign(a, b) + 1])
    if name == "rcc8":
        return Calculus(RCC8, range(1, 1 << 7), _rcc_of)
    if name == "cardinal":
        return Calculus(CARDINAL, product(range(3), repeat=2), lambda p, q: CARDINAL[3 * (_sign(p[0], q[0]) + 1) + _sign(p[1], q[1]) + 1])
    if name == "relative":
        return Calculus(RELATIVE, product(range(3), repeat=2), lambda p, q: RELATIVE[3 * (_sign(p[0], q[0]) + 1) + _sign(p[1], q[1]) + 1])
    if name == "distance":
        return _distance()
    raise ValueError(f"no calculus {name}")


def _distance() -> Calculus:
    """Distance classes compose by the triangle inequality on their bounds."""
    self = Calculus.__new__(Calculus)
    self.names, self.bit = DISTANCE, {n: 1 << i for i, n in enumerate(DISTANCE)}
    self.full = (1 << len(DISTANCE)) - 1
    self.converse_of = {b: b for b in self.bit.values()}
    low, high = (0, *DISTANCE_BOUNDS), (*DISTANCE_BOUNDS, float("inf"))
    self.compose = {}
    for (i, a), (j, b) in product(enumerate(self.bit.values()), repeat=2):
        # Classes are (low, high], the first is {0}.
        least = max(0, low[i] - high[j], low[j] - high[i])
        most = high[i] + high[j]
        strict = min(i, j) == 0
        out = 0
        for k, c in enumerate(self.bit.values()):
            if strict:
                out |= c if k == max(i, j) else 0
            elif (high[k] > least or k == 0 and least == 0) and low[k] < most:
                out |= c
        self.compose[a, b] = out
    return self


def distance_class(value: Column) -> Column:
    """The class of a distance: the first whose upper bound it doesn't exceed."""
    out = F.when(value <= DISTANCE_BOUNDS[0], DISTANCE[0])
    for b, n in zip(DISTANCE_BOUNDS[1:], DISTANCE[1:], strict=False):
        out = out.when(value <= b, n)
    return out.otherwise(DISTANCE[-1])


def allen_relation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The base relation of intervals (a, b) and (c, d) as a column."""
    out = F.when(b < c, "before").when(b == c, "meets").when(d < a, "after").when(d == a, "metBy").when((a == c) & (b == d), "intervalEqual")
    out = out.when((a == c) & (b < d), "starts").when(a == c, "startedBy").when((b == d) & (a > c), "finishes").when(b == d, "finishedBy")
    return out.when((a > c) & (b < d), "during").when((a < c) & (b > d), "contains").when(a < c, "overlaps").otherwise("overlappedBy")


def network(stated: DataFrame, of: Calculus) -> DataFrame:
    """(ctx, a, b, mask) with both directions from stated (ctx, a, b, mask): statements meet, converses agree."""
    pairs = stated.sparkSession.createDataFrame([(1 << i, of.converse_of[1 << i]) for i in range(len(of.names))], "r int, c int")
    bits = F.array(*(F.lit(1 << i) for i in range(len(of.names))))
    each = stated.withColumn("r", F.explode(F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) != 0)))
    turned = each.join(F.broadcast(pairs), "r").groupBy("ctx", "a", "b", "mask").agg(F.bit_or("c").alias("m"))
    both = stated.select("ctx", "a", "b", "mask").union(turned.select("ctx", F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("mask")))
    return both.groupBy("ctx", "a", "b").agg(F.bit_and("mask").alias("mask"))


def path_consistent(stated: DataFrame, of: Calculus, most: int | None = None) -> DataFrame:
    """The network with every edge cut to what all two-step routes allow; a mask 0 makes its context inconsistent.

    Each round joins the edges that the last one changed to all edges on the middle node, on both
    sides, and to the composition table; an edge between nodes of a context that nothing relates
    stays out (anything is possible).
    """
    spark = stated.sparkSession
    table = F.broadcast(of.table(spark))
    bits = F.array(*(F.lit(1 << i) for i in range(len(of.names))))
    split = lambda df: df.withColumn("r", F.explode(F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) != 0)))

    def routes(first: DataFrame, second: DataFrame) -> DataFrame:
        one = split(first).select("ctx", "a", F.col("b").alias("j"), F.col("r").alias("r1"))
        two = split(second).select("ctx", F.col("a").alias("j"), "b", F.col("r").alias("r2"))
        return one.join(two, ["ctx", "j"]).where("a <> b").join(table, ["r1", "r2"]).groupBy("ctx", "a", "j", "b").agg(F.bit_or("mask").alias("mask")).select("ctx", "a", "b", "mask")

    now = changed = settled(network(stated, of))
    for _ in rounds(most):
        found = now.union(routes(changed, now)).union(routes(now, changed))
        new = settled(found.groupBy("ctx", "a", "b").agg(F.bit_and("mask").alias("mask")).where(F.col("mask") != of.full))
        changed = settled(new.join(now, ["ctx", "a", "b", "mask"], "left_anti"))
        if changed.isEmpty():
            return new
        now = new


def entailed(tight: DataFrame, of: Calculus, *names: str) -> DataFrame:
    """(ctx, a, b) where the relation must be one of `names`; inconsistent contexts answer nothing."""
    bad = tight.where("mask = 0").select("ctx").distinct()
    return tight.where(F.col("mask").bitwiseAND(of.full & ~of.mask(*names)) == 0).join(bad, "ctx", "left_anti").select("ctx", "a", "b")
