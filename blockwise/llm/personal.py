"""Personal data by boosted trees over candidate spans.

Generators propose overlapping spans of four kinds: the base patterns (email,
ip, card, phone) and looser ones (bracketed or spaced signs, other
separators, no plus sign, a failing check digit). A base match that passes
its check is personal data, one that fails is not; these labels train
gradient-boosted trees on the format and the context of a span, never on the
check itself (check digit, parts up to 255). The trees score the looser
spans, isotonic regression turns margins into probabilities, and for each
kind the smallest probability that keeps ``PRECISION`` on rows the trees have
not seen selects what is redacted besides the base spans. A loose card number
that passes the check digit has its probability raised by Bayes' rule.

Built-in functions and MLlib only. A text is split at a pattern and the
matches are extracted beside it, so the lengths of the pieces give each
match its place; all later steps work on the narrow table of matches. The
patterns start where a run starts and repeat possessively, so no text makes
them backtrack over itself.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from blockwise.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
PARTS = 5                   # parts of the base spans, by hash: 0 calibrates, the others train
CONTEXT = 24

# fixed values: the base patterns, written so that they never backtrack
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GAP = r"[\x20._/ ‐-―-]"
_AT = r"(?:\x20{0,2}@\x20{0,2}|\x20{0,2}[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20{0,2})"
_DOT = r"(?:\.|\x20{0,2}[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20{0,2})"
LOOSE = {
    "email": [rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{0,8}}"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({]?\.[\])}]?\x20?[0-9]{1,3}){3}(?![0-9])"],
    # a number that runs on into the next one, or is set apart by other signs
    "card": [r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])", rf"(?<![0-9A-Za-z])[0-9](?:{_GAP}{{0,2}}[0-9]){{11,18}}(?![0-9A-Za-z])"],
    "phone": [r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", rf"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{{7,12}}|\(?[0-9]{{2,5}}\)?(?:{_GAP}{{1,2}}[0-9]{{2,5}}){{1,5}})(?![0-9A-Za-z])"],
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def matches(text: Column, pattern: str) -> Column:
    """Array of (gap, x, before, after): the leftmost non-overlapping matches
    in order, each with the number of code points since the last one."""
    both = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"),
                            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))
    # the outer transform binds the pieces
    return F.transform(both, lambda s: F.transform(s["hits"], lambda x, i: F.struct(
        F.char_length(s["gaps"][i]).alias("gap"), x.alias("x"), F.right(s["gaps"][i], F.lit(CONTEXT)).alias("before"),
        F.left(s["gaps"][i + 1], F.lit(CONTEXT)).alias("after"))))[0]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def double(c, i):
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0))

    each = F.transform(F.split(F.reverse(number), ""), double)
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: Column, x: Column) -> Column:
    """Whether a base match passes the check of its kind."""
    n = F.char_length(digits(x))
    card = F.when(n.between(12, 19), luhn(digits(x))).otherwise(F.lit(False))
    return (F.when(kind == "ip", x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == "card", card)
            .when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def _undisguised(kind: Column, x: Column) -> Column:
    """A loose span as its kind is usually written."""
    plain = F.regexp_replace(F.regexp_replace(x, r"(?i)\x20*[\[({]\x20?(?:at|@)\x20?[\])}]\x20*|\x20*@\x20*", "@"),
                             r"(?i)\x20*[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20*", ".")
    return (F.when(kind == "email", plain).when(kind == "ip", F.regexp_replace(x, r"[\x20\[\](){}]", "")).otherwise(x))


def _plausible(kind: Column, x: Column) -> Column:
    """Whether an undisguised span has its kind's form."""
    n = F.char_length(digits(x))
    return (F.when(kind == "email", x.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"))
            .when(kind == "ip", x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == "card", n.between(12, 19)).otherwise(n.between(9, 15)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: (rid, doc_id), one for each row of ``docs``. spans:
    (rid, k, kind, start, stop, x, before, after, base, valid) of every
    generator's matches, x with its disguise undone."""
    t = F.coalesce(F.col(text), F.lit(""))
    signs = {"email": F.contains(t, F.lit("@"))}
    loose_email = signs["email"] | t.rlike(r"[\[({]\x20?(?:at|AT|@)\x20?[\])}]")
    number = t.rlike("[0-9]")
    found = []
    for k, kind in enumerate(KINDS):
        for g, pattern in enumerate([BASE[kind], *LOOSE[kind]]):        # generator 0 is the base pattern
            some = (loose_email if g else signs["email"]) if kind == "email" else number
            found.append(F.struct(F.lit(k).cast("byte").alias("k"), F.lit(g).cast("byte").alias("g"),
                                  F.when(some, matches(t, pattern)).alias("hits")))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                           F.filter(F.array(*found), lambda s: F.size(s["hits"]) > 0).alias("found")))
    d = rows.select("rid", F.explode("found").alias("f")).select("rid", "f.k", "f.g", F.posexplode("f.hits").alias("pos", "h"))
    d = d.select("rid", "k", "g", (F.col("g") == 0).alias("base"), "pos", "h.*")
    order = Window.partitionBy("rid", "k", "g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("x")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k").cast("int") + 1)
    d = d.withColumn("stop", F.sum(F.col("gap") + n).over(order)).withColumn("kind", kind)
    d = d.withColumn("start", F.col("stop") - n).withColumn(
        "x", F.when(F.col("base"), F.col("x")).otherwise(_undisguised(F.col("kind"), F.col("x"))))
    spans = d.select("rid", "k", "kind", "start", "stop", "x", "before", "after", "base",
                     F.when(F.col("base"), _valid(F.col("kind"), F.col("x")))
                     .otherwise(_plausible(F.col("kind"), F.col("x"))).alias("valid"))
    return rows.select("rid", "doc_id"), cut(spans)


def _features(spans: DataFrame) -> DataFrame:
    """``spans`` with the word before (``cue``) and the dense features ``f``."""
    x, before, after = F.col("x"), F.col("before"), F.col("after")

    def count(c, pattern):
        return F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))

    groups = F.filter(F.split(x, "[^0-9]+"), lambda g: F.char_length(g) > 0)
    sizes = F.transform(groups, lambda g: F.char_length(g))
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    values = [*[(F.col("kind") == k).cast("int") for k in KINDS], F.char_length(x), F.char_length(digits(x)), F.size(groups),
              F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), count(x, "[A-Za-z]"),
              count(x, r"\x20"), count(x, r"\."), count(x, "-"), count(x, r"[()]"), F.size(F.array_distinct(F.split(digits(x), ""))),
              last.rlike("[A-Za-z]").cast("int"), last.rlike("[0-9]").cast("int"), last.rlike(r"[\x20\n\t]").cast("int"),
              (F.char_length(before) == 0).cast("int"), first.rlike("[A-Za-z]").cast("int"), first.rlike("[0-9]").cast("int"),
              first.rlike(r"[\x20\n\t]").cast("int"), (F.char_length(after) == 0).cast("int"), count(before, "[0-9]"),
              count(after, "[0-9]"), before.rlike("[=\"':#]").cast("int"), after.rlike("[=\"':#]").cast("int")]
    f = F.array(*[v.cast("double") for v in values])
    cue = F.lower(F.regexp_extract(before, r"([A-Za-zÀ-ɏ]+)[^A-Za-zÀ-ɏ]*$", 1))
    return spans.withColumns({"f": f, "cue": cue})


def _thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """{kind: probability} from (kind, p, y) of calibration rows: the smallest
    that keeps the precision among them, and no more than the precision where
    all of a kind keep it. A kind without such rows gets the largest."""
    by = scored.groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    w = Window.partitionBy("kind").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("share", F.sum("y").over(w) / F.sum("n").over(w))
    kept = F.min(F.when(F.col("share") >= precision, F.col("p")))
    out = {}
    for kind, t, whole in by.groupBy("kind").agg(kept, F.min_by("share", "p")).collect():      # four at most
        out[kind] = 2.0 if t is None else min(t, precision) if whole >= precision else t
    return {k: out.get(k, max(out.values(), default=2.0)) for k in KINDS}


def _cue_odds(train: DataFrame, share: float) -> DataFrame:
    """(kind, cue, odds) of every word before a span of ``train``: its log odds
    over all of them, in odds[0], and over those outside part i, in odds[i]."""
    n, y = F.count(F.lit(1)), F.sum("y")
    own = [(F.count_if(F.col("part") == i), F.sum(F.when(F.col("part") == i, F.col("y")).otherwise(0))) for i in range(1, PARTS)]
    odds = [F.log((y - oy + share) / (n - on - (y - oy) + 1 - share)) for on, oy in [(F.lit(0), F.lit(0)), *own]]
    return train.groupBy("kind", "cue").agg(F.array(*odds).alias("odds"))


def score_spans(spans: DataFrame, precision: float = PRECISION, trees: int = 20, depth: int = 4) -> DataFrame:
    """(rid, k, kind, start, stop, base, p, accepted) of the loose spans. The
    trees are fitted on all base spans but a fifth (by a hash of the span),
    which is kept for calibration. A training span's odds of the word before
    it come from the other parts, so that no label tells of itself. Without
    spans of both labels p is the share of valid ones (0 when there are
    none)."""
    known = spans.filter("base").withColumn("y", F.col("valid").cast("int")).select("kind", "x", "before", "after", "y")
    known = cut(_features(known).select("kind", "cue", "f", "y", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int").alias("part")))
    seen = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    loose = spans.filter("not base and valid").select("rid", "k", "kind", "start", "stop", "base", "x", "before", "after")
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    train = known.filter("part > 0")
    if len(seen) < 2 or {r["y"] for r in train.select("y").distinct().collect()} != {0, 1}:
        return loose.select("rid", "k", "kind", "start", "stop", "base", F.lit(float(share)).alias("p"),
                            F.lit(share >= precision).alias("accepted"))
    cues = cut(_cue_odds(train, share))

    def vectors(frame, part):
        d = frame.join(cues, ["kind", "cue"], "left").withColumn("odds", F.coalesce(F.get("odds", part), F.lit(0.0)))
        return d.withColumn("features", array_to_vector(F.concat("f", F.array("odds")))).drop("f", "cue", "odds")

    weight = F.when(F.col("y") == 1, F.lit(0.5 / seen[1])).otherwise(F.lit(0.5 / seen[0])) * sum(seen.values())
    train = cut(vectors(known, F.col("part")).withColumn("weight", weight))
    gbt = GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth,
                        stepSize=0.2, minInstancesPerNode=5, seed=42).fit(train.filter("part > 0"))

    def margin(frame):
        return gbt.transform(frame).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("prediction")

    held = train.filter("part = 0")
    held = cut(margin(train if held.isEmpty() else held).select("kind", "margin", "y"))
    # equal margins are one weighted point
    points = held.groupBy("margin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    iso = IsotonicRegression(featuresCol="margin", labelCol="y", weightCol="n").fit(points)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("p")
    limit = _thresholds(iso.transform(held).select("kind", p, "y"), precision)
    least = F.element_at(F.array(*[F.lit(limit[k]) for k in KINDS]), F.col("k").cast("int") + 1)
    scored = iso.transform(margin(vectors(_features(loose), F.lit(0)))).select("rid", "k", "kind", "start", "stop", "base", "x", p)
    # a loose span that passes the check after all; one number in ten does by chance
    passes = F.when((F.col("kind") == "card") & F.char_length(digits(F.col("x"))).between(12, 19), luhn(digits(F.col("x"))))
    scored = scored.withColumn("p", F.when(passes, F.col("p") / (F.col("p") + (1 - F.col("p")) / 10)).otherwise(F.col("p"))).drop("x")
    return scored.withColumn("accepted", F.col("p") >= least)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: (rid, doc_id) as in :func:`candidates`; spans:
    (rid, k, start, stop, base), code points, end exclusive: every valid base
    span, and the accepted loose spans that meet no base span, overlapping
    ones of a kind as one."""
    rows, all_spans = candidates(docs, id_col, text)
    base = all_spans.filter("base and valid").select("rid", "k", "start", "stop", "base")
    loose = score_spans(all_spans, **params).filter("accepted").select("rid", "k", "start", "stop", "base")
    d = cut(base.union(loose))
    back = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("reach", F.max(F.when(F.col("base"), F.col("stop"))).over(back))
    d = d.withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(ahead))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True))
    extra = d.filter(~F.col("base") & free)
    w = Window.partitionBy("rid", "k").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    extra = extra.withColumn("new", F.coalesce((F.col("start") >= F.max("stop").over(w)).cast("int"), F.lit(1)))
    island = F.sum("new").over(Window.partitionBy("rid", "k").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0))
    extra = extra.withColumn("island", island).groupBy("rid", "k", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")).select("rid", "k", "start", "stop", F.lit(False).alias("base"))
    return rows, d.filter("base").select("rid", "k", "start", "stop", "base").union(extra)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added):
    one row per row of ``docs``. The counts and the hash are of the base
    spans; ``spans`` lists all as kind:start:stop by start and kind. Null and
    empty texts have none; very long texts are searched whole; repeated rows
    come back repeated; a null id is kept; extra columns are not read; an
    empty table gives an empty result."""
    rows, spans = personal_spans(docs, id_col, text, **params)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k").cast("int") + 1)
    named = spans.withColumn("s", F.struct("start", "k", F.concat_ws(":", kind, "start", "stop").alias("t"), "base"))
    per = named.groupBy("rid").agg(
        *[F.count_if(F.col("base") & (F.col("k") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list("s")).alias("all"), F.count_if(~F.col("base")).alias("n_added"))
    names = F.transform("all", lambda s: s["t"])
    base = F.transform(F.filter("all", lambda s: s["base"]), lambda s: s["t"])
    per = per.select("rid", *[f"n_{k}" for k in KINDS], F.array_join(base, ",").alias("base"), F.array_join(names, ",").alias("spans"), "n_added")
    d = rows.join(per, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return d.select("doc_id", *[zero(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
