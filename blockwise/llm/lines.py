"""Near-duplicate lines by a segment-partition edit join.

Lines within ``edits`` insertions, deletions or substitutions are linked. A
line is split into ``edits + 1`` nearly equal segments; a partner within
``edits`` edits must hold one of them whole, within a few positions of its
place. Segments are indexed under (length of the line, segment number,
text); a line probes the index of every length it can match with the
substrings that the multi-match rule selects. Where more than ``hot`` lines
share a segment (templated lines, near copies), what is left of them without
it is within ``edits`` edits too, so it is split and probed in the same way,
until few lines share all segments so far or nothing is left to split. Lines
of a group that share all of their places but ``edits`` characters or fewer
are within ``edits`` of each other: every two of them are linked without
being compared. Every round is exact, and every two lines within ``edits`` are
linked. Lines that share a segment meet only if
their counts of characters, by class, leave them within ``edits`` (near copies
with more edits do not). Candidates whose first or last
characters are too far apart go; the others are verified by a banded
bit-parallel automaton: one word of 2 * edits + 1 diagonals for each number
of edits, moved along the line.

Built-in functions only. Equal lines are one line (a 64-bit hash names it)
from the start: copies are counted with partial aggregation and never
paired. Lines shorter than ``min_chars`` match exact copies only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from blockwise.llm.common import cut, numbered
from blockwise.llm.components import connected_components

EDITS = 2
MIN_CHARS = 20
PART = 256           # lines of a group without a difference that meet all others of it in one task
HOT = 64             # lines that may share a segment without a further split (their bags are compared)


def _segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """1-based start and size of segment i (1 ..) of a line."""
    k = edits + 1
    size = F.floor(length / k)
    long_from = k - (length % k)                    # segments after this one are longer by one
    start = (i - 1) * size + 1 + F.greatest(F.lit(0), i - 1 - long_from)
    return start.cast("int"), (size + (i > long_from).cast("int")).cast("int")


def _spots(edits: int) -> list[tuple[int, int, int]]:
    """(delta, segment, move): substrings that may equal a segment of a line
    shorter by delta (the multi-match-aware selection). Of delta 0 those with
    move 0 are the line's own segments, which the index holds."""
    out = []
    for delta in range(edits + 1):
        for i in range(1, edits + 2):
            lo = max(-(i - 1), delta - (edits + 1 - i))
            hi = min(i - 1, delta + (edits + 1 - i))
            out += [(delta, i, move) for move in range(lo, hi + 1)]
    return out


def _table(edits: int) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(m).alias("move"))
                     for d, i, m in _spots(edits)])


def _tables(edits: int) -> Column:
    """The same spots in an array for each delta."""
    return F.array(*[F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(m).alias("move"))
                               for d, i, m in _spots(edits) if d == delta]) for delta in range(edits + 1)])


def _place(n: Column, spot: Column, edits: int) -> tuple[Column, Column, Column]:
    """Length of the partner, and place and size of the substring."""
    length = n - spot["delta"]
    start, size = _segment(length, spot["i"], edits)
    return length, start + spot["move"], size


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """(key, lid, spot) of the substrings of (lid, line) that lie inside the
    line, the spot by its number in the table. The spots are exploded first,
    so the expressions are compiled, and evaluated once for each spot."""
    spot = F.col("s")
    d = lines.select("lid", "line", F.char_length("line").alias("n"), F.posexplode(_table(edits)).alias("spot", "s"))
    length, at, size = _place(F.col("n"), spot, edits)
    d = d.select("lid", "line", "n", F.col("spot").cast("byte").alias("spot"), spot["i"].alias("i"), length.alias("length"),
                 at.alias("at"), size.alias("size")).filter("at >= 1 and at + size - 1 <= n")
    return d.select(F.xxhash64("length", "i", F.substring("line", F.col("at"), F.col("size"))).alias("key"), "lid", "spot")


def _met(keys: DataFrame, own: Column) -> DataFrame:
    """The different rows of :func:`_keys` whose key has another line and an
    own one. Most keys have one line; they go first. Both readers of the keys
    share one shuffle, so the substrings are cut and hashed once."""
    keys = keys.repartition("key")
    met = keys.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max(own).alias("o"))
    return keys.join(met.filter("lo < hi and o").select("key").hint("merge"), "key").distinct()


def _rest(line: Column, spot: Column, edits: int) -> Column:
    """The line without the substring at a spot."""
    _, at, size = _place(F.char_length(line), spot, edits)
    return F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + size, F.char_length(line)))


def _again(rows: DataFrame, edits: int) -> DataFrame:
    """(key, lid, delta, own, rest) of a refined step: what is left of a line
    is split like a line, below the key that it has."""
    spot = F.col("s")
    d = rows.select("key", "lid", "delta", "own", "rest", F.char_length("rest").alias("n"),
                    F.explode(F.get(_tables(edits), F.col("delta"))).alias("s"))
    length, at, size = _place(F.col("n"), spot, edits)
    d = d.select(
        "key", "lid", "delta", (F.col("own") & (spot["move"] == 0)).alias("own"), "rest", "n", spot["i"].alias("i"),
        length.alias("length"), at.alias("at"), size.alias("size")).filter("at >= 1 and at + size - 1 <= n")
    place, n = F.col("at"), F.col("size")
    rest = F.concat(F.substring("rest", F.lit(1), place - 1), F.substring("rest", place + n, F.col("n")))
    return d.select(F.xxhash64("key", "length", "i", F.substring("rest", place, n)).alias("key"), "lid", "delta", "own",
                    rest.alias("rest")).distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key another line may meet, with the number of rows that
    the smaller side of the key has."""
    groups = rows.groupBy("key").agg(F.count_if("own").alias("o"), F.count(F.lit(1)).alias("m"))
    groups = groups.filter("o > 0 and m > 1").select("key", F.least("o", F.col("m")).alias("side"))
    return rows.join(groups, "key")


CLASSES = ["".join(chr(c) for c in range(0x20, 0x250) if c % 16 == k) for k in range(16)]


def _bag(line: Column) -> Column:
    """How many characters of each class a line has; classes share none."""
    return F.array(*[(F.char_length(line) - F.char_length(F.translate(line, c, ""))) for c in CLASSES])


def _near_bags(a: str, b: str, edits: int) -> Column:
    """Whether two bags may be of lines within ``edits``: an edit takes at most
    one character out of a class and puts one into another."""
    return reduce(lambda x, y: x + y, [F.abs(F.col(a)[k] - F.col(b)[k]) for k in range(len(CLASSES))]) <= 2 * edits


def _met_lines(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, lid, delta, own, star, bag), one row per key and line; a line that
    stands in a key as its own and shifted counts as its own."""
    rows = rows.groupBy("key", "lid").agg(
        F.max("own").alias("own"), F.min("delta").alias("delta"), F.max("star").alias("star"))
    return rows.join(texts.select("lid", "bag"), "lid")


def _pairs(rows: DataFrame, edits: int) -> DataFrame:
    """(a, b, sure) of lines of :func:`_met_lines` that meet in a key and whose
    bags of characters leave them within the edits. Lines of one length meet
    once. Own lines of a key with ``star`` are sure to be within the edits of
    each other."""
    index = rows.filter("own").select("key", F.col("lid").alias("other"), F.col("bag").alias("others"))
    met = rows.filter("not (own and star)").select("key", "lid", "delta", "bag").join(index, "key").filter(
        F.expr("other < lid or (delta > 0 and other <> lid)") & _near_bags("bag", "others", edits))
    met = met.select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b"), F.lit(False).alias("sure"))
    sure = _every_two(rows.filter("own and star").select("key", "lid")).withColumn("sure", F.lit(True))
    return met.union(sure).groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _every_two(rows: DataFrame) -> DataFrame:
    """(a, b) with a < b: every two lines of a key of the different (key, lid).
    Keys that hold the same lines (told by their number, ends and 128 hashed
    bits; one group is reached by many splits) count once. The lines of a key
    are dealt into parts of about ``PART``, each of which meets all of them in
    a task of its own."""
    bits = [F.bit_xor(F.xxhash64(F.lit(i), "lid")).alias(f"x{i}") for i in range(2)]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("lo"), F.max("lid").alias("hi"), *bits)
    keys = keys.filter("n > 1").groupBy("n", "lo", "hi", "x0", "x1").agg(F.min("key").alias("key"))
    d = rows.join(keys.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "key")
    one = d.select("key", F.col("lid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = d.select("key", F.col("lid").alias("b"), F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int").alias("part"))
    return one.join(other, ["key", "part"]).filter("a < b").select("a", "b")


def _alike(a: Column, b: Column, edits: int, width: int = 16) -> Column:
    """Whether the first and the last ``width`` characters leave two strings
    within ``edits`` of each other: an end of one within ``edits`` of some end
    of the other is within twice that of its end of the same length."""
    return ((F.levenshtein(F.left(a, F.lit(width)), F.left(b, F.lit(width)), 2 * edits) >= 0)
            & (F.levenshtein(F.right(a, F.lit(width)), F.right(b, F.lit(width)), 2 * edits) >= 0))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """True where the edit distance of two strings is at most ``edits``. Bit
    d + edits of word e is set when a[:i] reaches b[:i + d] with e edits."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    # row 0: b[:d] costs d insertions
    start = F.array(*[F.lit(sum(1 << (d + edits) for d in range(e + 1))) for e in range(edits + 1)])

    def step(x, y, words, i):
        c = F.get(x, i - 1)
        match = F.lit(0)
        for d in range(-edits, edits + 1):
            match = match + F.when(F.get(y, i + d - 1) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0))

        def move(m):
            out = [words[0].bitwiseAND(m)]
            for e in range(1, edits + 1):       # match, substitute, delete, insert
                out.append(words[e].bitwiseAND(m).bitwiseOR(words[e - 1]).bitwiseOR(F.shiftright(words[e - 1], 1))
                           .bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
            return F.array(*out)

        # the transform binds the match word; a dead state stays as it is
        return F.when(words[edits] == 0, words).otherwise(F.transform(F.array(match), move)[0])

    gap = F.char_length(b) - F.char_length(a) + edits
    # the transform binds the split strings, which would be split at every use
    both = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    last = F.transform(both, lambda s: F.aggregate(
        F.sequence(F.lit(1), F.char_length(a)), start, lambda words, i: step(s["x"], s["y"], words, i)))[0]
    reached = F.call_function("shiftright", F.element_at(last, -1), gap).bitwiseAND(F.lit(1)) == 1
    return (gap >= 0) & (gap < width) & F.when(F.char_length(a) == 0, F.lit(True)).otherwise(reached)


WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(lid, line) of the lines that hold a word, repeats included."""
    d = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    return d.filter(F.col("line").rlike(WORD)).select(F.xxhash64("line").alias("lid"), "line")


def _spots_of(text: Column) -> Column:
    """Array of (pos, lid): the same lines with their place, without the text."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(WORD), F.struct(i.alias("pos"), F.xxhash64(x).alias("lid"))))
    return F.coalesce(F.filter(every, lambda x: x.isNotNull()), F.array().cast("array<struct<pos:int,lid:bigint>>"))


def line_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(a, b) with a < b of (lid, line): every pair of different lines, named
    by hash, within ``edits`` edits, both of ``min_chars`` characters or more."""
    if min_chars < edits + 1:
        raise ValueError("a line needs a character for each segment")
    lines = lines.filter(F.char_length("line") >= min_chars).select("lid", "line")
    own = F.col("spot").isin([k for k, (delta, _, move) in enumerate(_spots(edits)) if delta == move == 0])
    rows = cut(_met(_keys(lines, edits), own))
    rows = cut(_shared(rows.select("key", "lid", "spot", _table(edits)[F.col("spot")]["delta"].alias("delta"), own.alias("own"))))
    used = rows.select("lid").distinct()
    texts = cut(lines.join(used.hint("merge"), "lid").groupBy("lid").agg(F.min("line").alias("line"))
                .withColumn("bag", _bag(F.col("line"))))
    met = ["key", "lid", "delta", "own"]
    parts = [rows.filter(F.col("side") <= hot).select(*met, F.lit(False).alias("star"))]
    rows = cut(rows.filter(F.col("side") > hot).join(texts.select("lid", "line"), "lid").select(
        "key", "lid", "delta", "own", "side", _rest(F.col("line"), _table(edits)[F.col("spot")], edits).alias("rest")))
    while not rows.isEmpty():       # each round leaves at most edits / (edits + 1) of a line
        left = F.char_length("rest") - F.col("delta")       # of the own lines of the key
        more = (F.col("side") > hot) & (left > edits)
        parts.append(rows.filter(~more).select(*met, (left <= edits).alias("star")))
        rows = cut(_shared(_again(rows.filter(more), edits)))
    pairs = cut(_pairs(cut(_met_lines(reduce(DataFrame.union, parts), texts)), edits))
    texts = texts.select("lid", "line")
    both = pairs.filter("not sure").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    fits = _alike(F.col("x"), F.col("y"), edits) & within_edits(F.col("x"), F.col("y"), edits)
    return cut(pairs.filter("sure").select("a", "b").union(both.filter(fits).select("a", "b")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, n_lines, n_linked, n_links, dropped): one row per row of
    ``docs``. A class of lines is what links connect; of each class the first
    line by (doc_id, row number, position) stays and ``dropped`` lists the
    positions (from 0) of the others in this row. n_linked counts the row's
    lines with a link, to a line of another text, and n_links those links.
    Lines without a word are not counted.
    Null and empty texts have no lines; repeated rows are rows of their own;
    null ids sort first; extra columns are not read."""
    rows = numbered(docs, "d", F.col(id_col).alias("doc_id"), _spots_of(F.col(text)).alias("spots"))
    return _plan(rows, _lines(docs, text), **params).drop("d")


def _plan(rows: DataFrame, lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The same with the row number, from (d, doc_id, spots) and (lid, line)."""
    links = line_links(lines, edits, min_chars)
    degree = links.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count(F.lit(1)).alias("links"))
    roots = connected_components(links).withColumnRenamed("node", "lid").join(degree, "lid")
    spots = rows.select("doc_id", "d", F.explode("spots").alias("s")).select("doc_id", "d", "s.pos", "s.lid")
    place = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "d", "pos")
    lid = cut(spots.groupBy("lid").agg(F.min(place).alias("first")).join(roots, "lid", "left")
              .select("lid", "first", F.coalesce("root", "lid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    first = lid.groupBy("root").agg(F.min("first").alias("keep"))
    lid = lid.join(first, "root").select("lid", "links", "keep.d", "keep.pos")
    s = spots.select("d", "pos", "lid").join(lid.withColumnsRenamed({"d": "kd", "pos": "kpos"}), "lid")
    drop = ~((F.col("d") == F.col("kd")) & (F.col("pos") == F.col("kpos")))
    per = s.groupBy("d").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("links") > 0).alias("n_linked"),
        F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(drop, F.col("pos")))).alias("dropped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("d", "doc_id").join(per, "d", "left").select(
        "doc_id", "d", zero("n_lines"), zero("n_linked"), zero("n_links"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with the dropped lines cut out of the text, all columns kept."""
    names = docs.columns
    rows = numbered(docs, "d", F.col(id_col).alias("doc_id"), _spots_of(F.col(text)).alias("spots"), F.struct(*names).alias("row"))
    plan = _plan(rows.select("d", "doc_id", "spots"), _lines(docs, text), **params).select("d", "dropped")
    d = rows.select("d", "row").join(plan, "d")
    kept = F.filter(F.split(F.col("row")[text], "\n"), lambda x, i: ~F.array_contains("dropped", i))
    return d.select(*[F.array_join(kept, "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
