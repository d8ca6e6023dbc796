"""Secrets in texts, in DataFrame operations only: fixed shapes, and tokens that pass a battery of randomness tests.

Fixed shapes are assignments to a telling name, access keys and long runs of lower-case hexadecimal digits. Beside them every run of
`SHORTEST` or more token characters is a candidate. Its encoding is the smallest alphabet that holds it, and over the places
of its characters in that alphabet three tests ask whether it looks random: chi-squared for a uniform use of the alphabet, the
number of runs in the lower and upper half, and the serial correlation of neighbours. A candidate that any of them rejects
(at `ALPHA`, shared among the three) is ordinary.

What is left must also be unlike ordinary text. The ordinary use of each alphabet is counted over all shorter runs of all texts (of letters in either case, if the alphabet has one);
under it the chi-squared value of a token of n characters has a known mean and deviation, so a candidate far
below the mean is a discovery, and a short one, for which both look alike, is not. The false discovery rate is held at `RATE`
by the step-up rule of Benjamini and Hochberg, within bands of lengths, so that many short candidates do not lower the bar for long ones.
Values are counted on a grid of `GRID` steps per deviation, rounded to the ordinary side, so the rule needs one small table.

Every row is numbered first and carries only lengths and test values from then on; texts are neither shuffled nor kept.

Defined results: null and empty texts have no spans; repeated rows get equal spans; spans of the method that touch one of the fixed
shapes are left out, those stay as they are; an empty table gives no rows; columns besides `doc_id` and `text` are not looked
at. Texts are read whole. Places are code points from 0, the end is exclusive.
"""

from __future__ import annotations

import string
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.session import checkpointed

# The names, the characters and the shortest lengths of the fixed shapes.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ASSIGNED = 8
SHAPES = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}+", "hex": "[0-9a-f]{32,}+"}
KINDS = [*SHAPES, "random"]

SHORTEST = 20
TOKEN = "[A-Za-z0-9+/_-]"
LETTERS = string.ascii_uppercase + string.ascii_lowercase
ONE_CASE = ["decimal", "hex", "HEX", "base32", "base36", "BASE36"]
# From the smallest on. An alphabet's half is the lower or upper part in this order.
ALPHABETS = {
    "decimal": string.digits,
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": LETTERS + string.digits,
    "base64": LETTERS + string.digits + "+/",
    "base64url": LETTERS + string.digits + "-_",
    "any": LETTERS + string.digits + "+/-_",
}
ALPHA = 0.001
RATE = 0.01
GRID = 50
FURTHEST = 40  # deviations; further ones count as this far
BANDS = [24, 32, 48, 64, 128]  # lengths at which a new band begins


def _cut(name: str, kind: str, pattern: str) -> list[Column]:
    """Lengths between the matches, and the matches."""
    text = F.coalesce(F.col(name), F.lit(""))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return [gaps.alias(f"{kind}_gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"{kind}_found")]


def _encoding(token: Column) -> Column:
    name = F.lit("any")
    for encoding, alphabet in reversed(ALPHABETS.items()):
        escaped = alphabet.replace("-", r"\-")
        name = F.when(token.rlike(f"^[{escaped}]*$"), F.lit(encoding)).otherwise(name)
    return name


def _by_encoding(encoding: Column, values: dict) -> Column:
    found = F.lit(None)
    for name, value in values.items():
        found = F.when(encoding == name, F.lit(value)).otherwise(found)
    return found


def _measures(tokens: DataFrame) -> DataFrame:
    """Adds n, encoding, size, chi (chi-squared for uniform use), runs and serial (both in deviations) to rows with a `token`."""
    rows = tokens.withColumn("encoding", _encoding(F.col("token"))).withColumn("n", F.length("token"))
    rows = rows.withColumn("size", _by_encoding(F.col("encoding"), {k: len(a) for k, a in ALPHABETS.items()}))
    alphabet = _by_encoding(F.col("encoding"), ALPHABETS)
    rows = rows.withColumn("alphabet", alphabet)
    rows = rows.withColumn("places", F.expr("transform(split(token, ''), c -> cast(locate(c, alphabet) - 1 AS bigint))"))
    # Sum of the squared counts: in sorted order the m-th of its kind adds 2m - 1.
    squares = F.expr(
        "aggregate(array_sort(places), named_struct('last', -1L, 'm', 0L, 'sum', 0L), (a, p) -> named_struct("
        "'last', p, 'm', if(p = a.last, a.m + 1, 1L), 'sum', a.sum + 2 * if(p = a.last, a.m + 1, 1L) - 1)).sum"
    )
    changes = F.expr(
        "aggregate(places, named_struct('last', -1, 'changes', 0L), (a, p) -> named_struct('last', if(2 * p < size, 0, 1), "
        "'changes', a.changes + if(a.last >= 0 and a.last <> if(2 * p < size, 0, 1), 1, 0))).changes"
    )
    rows = rows.withColumns({"squares": squares, "changes": changes, "total": F.expr("aggregate(places, 0L, (a, p) -> a + p)")})
    rows = rows.withColumn("power", F.expr("aggregate(places, 0L, (a, p) -> a + p * p)"))
    rows = rows.withColumn(
        "lagged",
        F.expr("aggregate(places, named_struct('last', -1L, 'sum', 0L), (a, p) -> named_struct('last', p, "
               "'sum', a.sum + if(a.last >= 0, a.last * p, 0))).sum"),
    )
    n, mean = F.col("n").cast("double"), F.col("total") / F.col("n")
    # Sum of (x[i] - mean)(x[i + 1] - mean), and of the squares, in units that the mean of a constant token makes 0.
    ends = F.element_at("places", 1) + F.element_at("places", -1)
    product = F.col("lagged") - mean * (2 * F.col("total") - ends) + (n - 1) * mean * mean
    spread = F.col("power") - n * mean * mean
    return rows.select(
        *tokens.columns, "encoding", "n", "size",
        (F.col("size") / n * F.col("squares") - n).alias("chi"),
        ((F.col("changes") - (n - 1) / 2) / (F.sqrt(n - 1) / 2)).alias("runs"),
        F.when(spread > 1e-9, (product / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(float(FURTHEST))).alias("serial"),
        "squares",
    )


def _looks_random() -> Column:
    """Whether none of the three tests rejects the random use of the alphabet at ALPHA / 3 each."""
    two_sided = NormalDist().inv_cdf(1 - ALPHA / 6)
    upper = NormalDist().inv_cdf(1 - ALPHA / 3)
    free = (F.col("size") - 1).cast("double")
    # Wilson and Hilferty: the cube root of a chi-squared value over its degrees of freedom is close to normal.
    chi = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    return (chi <= upper) & (F.abs("runs") <= two_sided) & (F.abs("serial") <= two_sided)


def ordinary_use(documents: DataFrame) -> DataFrame:
    """encoding, s2, s3: sums of the squared and cubed shares of an alphabet's characters in all runs below SHORTEST."""
    runs = documents.select(F.explode(F.regexp_extract_all("text", F.lit(f"{TOKEN}++"), F.lit(0))).alias("run"))
    counted = runs.filter(F.length("run") < SHORTEST).groupBy("run").agg(F.count("*").alias("times"))
    signs = counted.select(F.explode(F.split("run", "")).alias("sign"), "times").groupBy("sign").agg(F.sum("times").alias("times"))
    signs = checkpointed(signs)
    # At most one row per character and alphabet; every character counts at least once.
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    members = documents.sparkSession.range(1).select(F.explode(alphabets).alias("encoding", "alphabet"))
    members = members.select("encoding", F.explode(F.split("alphabet", "")).alias("sign"))
    # In an alphabet of one case a letter stands for both, or capitals would look unused in most texts.
    folded = signs.groupBy(F.lower("sign").alias("sign")).agg(F.sum("times").alias("times"))
    one_case = F.col("encoding").isin(ONE_CASE)
    use = (
        members.filter(~one_case).join(F.broadcast(signs), "sign", "left")
        .unionByName(members.filter(one_case).withColumn("sign", F.lower("sign")).join(F.broadcast(folded), "sign", "left"))
        .select("encoding", (F.coalesce("times", F.lit(0)) + 1.0).alias("times"))
    )
    share = use.withColumn("share", F.col("times") / F.sum("times").over(Window.partitionBy("encoding")))
    return share.groupBy("encoding").agg(F.sum(F.pow("share", F.lit(2))).alias("s2"), F.sum(F.pow("share", F.lit(3))).alias("s3"))


def _band() -> Column:
    band = F.lit(0)
    for i, start in enumerate(BANDS):
        band = F.when(F.col("n") >= start, i + 1).otherwise(band)
    return band


def thresholds(candidates: DataFrame) -> DataFrame:
    """band, bar: grid steps below the ordinary mean from which a candidate of the band is a discovery (step-up rule)."""
    counted = candidates.groupBy("band", "step").agg(F.count("*").alias("rows"))
    # At most two sides of the grid per band.
    upto = Window.partitionBy("band").orderBy(F.desc("step"))
    counted = counted.withColumns({"beyond": F.sum("rows").over(upto), "all": F.sum("rows").over(Window.partitionBy("band"))})
    chances = F.lit([NormalDist().cdf(-i / GRID) for i in range(-FURTHEST * GRID, FURTHEST * GRID + 1)])
    passing = counted.withColumn("chance", F.get(chances, F.col("step") + FURTHEST * GRID)).filter(F.col("chance") * F.col("all") <= RATE * F.col("beyond"))
    return passing.groupBy("band").agg(F.min("step").alias("bar"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, kind, end) in the order of starts, then of kinds, for every row."""
    shapes = {**SHAPES, "random": f"{TOKEN}{{{SHORTEST},}}+"}
    cut = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[c for kind, pattern in shapes.items() for c in _cut("text", kind, pattern)],
    )
    # Of a fixed shape only lengths are kept, 0 for a match that is too short to count.
    long_enough = F.transform(
        "assign_found", lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGNED, F.length(m)).otherwise(-F.length(m))
    )
    lengths = {"assign": long_enough, **{k: F.transform(f"{k}_found", F.length) for k in ("access", "hex", "random")}}
    rows = checkpointed(
        cut.select(
            "row", "doc_id",
            F.array(*[
                F.struct(F.lit(i).alias("kind"), F.col(f"{k}_gaps").alias("gaps"), lengths[k].cast("array<int>").alias("lengths"))
                for i, k in enumerate(KINDS)
            ]).alias("kinds"),
            F.col("random_found").alias("tokens"),
        )
    )
    marked = rows.select("row", F.explode("kinds").alias("k"), "tokens").filter(F.size("k.lengths") > 0)
    token = F.when(F.col("k.kind") == KINDS.index("random"), F.get("tokens", F.col("nth")))
    matches = (
        marked.select("row", "k", "tokens", F.posexplode("k.lengths").alias("nth", "length"))
        .select("row", F.col("k.kind").alias("kind"), "nth", "length", F.get("k.gaps", F.col("nth")).alias("gap"), token.alias("token"))
    )
    within = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.abs("length")).over(within)
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.abs("length")).filter("length > 0")
    placed = checkpointed(placed.select("row", "kind", "start", "end", "token"))
    base = placed.filter("token IS NULL").select("row", "kind", "start", "end")
    spans = base.unionByName(_discoveries(documents, placed))
    # A span of the method must not touch a fixed shape: none that starts before may end inside, none may start inside.
    place = Window.partitionBy("row").orderBy("start", "kind")
    fixed = F.col("kind") < KINDS.index("random")
    last = F.max(F.when(fixed, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(fixed, F.col("start"))).over(place.rowsBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(last, F.lit(0)) <= F.col("start")) & (F.coalesce(following >= F.col("end"), F.lit(True)))
    kept = spans.withColumn("keep", fixed | clear).filter("keep")
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return rows.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _discoveries(documents: DataFrame, placed: DataFrame) -> DataFrame:
    """row, kind, start, end of the candidates that look random and unlike ordinary text."""
    measured = _measures(placed.filter("token IS NOT NULL"))
    ordinary = F.broadcast(checkpointed(ordinary_use(documents)))  # one row per alphabet
    n, size = F.col("n").cast("double"), F.col("size")
    mean = n + n * (n - 1) * F.col("s2")
    variance = 2 * n * (n - 1) * (F.col("s2") - F.pow("s2", F.lit(2)) + 2 * (n - 2) * (F.col("s3") - F.pow("s2", F.lit(2))))
    # Sum of the squared counts of an ordinary token: its mean and deviation by the length; chi-squared is linear in it.
    below = (mean - F.col("squares")) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
    step = F.floor(F.least(F.greatest(below, F.lit(-FURTHEST)), F.lit(FURTHEST)) * GRID).cast("int")
    tested = checkpointed(
        measured.join(ordinary, "encoding").select(
            "row", "kind", "start", "end", _band().alias("band"), step.alias("step"), _looks_random().alias("random")
        )
    )
    bars = F.broadcast(thresholds(tested))  # one row per band
    found = tested.join(bars, "band").filter(F.col("random") & (F.col("step") >= F.col("bar")))
    return found.select("row", "kind", "start", "end")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
