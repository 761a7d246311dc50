"""Every operator against a brute-force version, on a small fixture with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from blockwise.llm import (curriculum, decontam, kdshard, langid, lines, perspectives, quality, repeats, simhash,
                           toxicity)

EXTRA = "fp long, d long, shard int, size long, n int"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, out = text(70), []
    for i in range(40):
        t = text(rnd.randint(0, 90)) + rnd.choice(["", " " + shared + " "]) + text(rnd.randint(0, 60))
        out.append((i, t.replace(" b", "\nb"), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", "z", None])))
    out += [(100, None, "en", "s0"), (101, "", None, None), (102, "a" * 700, "en", "s0"), (3, *out[3][1:]),
            (104, out[5][1], "de", "s1"), (None, out[6][1], "de", "s1"), (105, "x " * 3000, "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.withColumns({c.split()[0]: F.lit(1).cast(c.split()[1]) for c in EXTRA.split(", ")}).cache()


def key(r):
    return [(x is None, str(x)) for x in r]


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("hot", [1024, 2])
def test_repeats(docs, rows, hot):
    got = repeats.remove_repeats(docs, hot=hot).drop("kept").collect()
    same(got, brute.repeats([(r[0], r[1]) for r in rows]))


def test_matching_statistics():
    rnd = random.Random(2)
    for _ in range(30):
        texts = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 25))) for _ in range(5)})
        ms = repeats.RunLengthIndex(texts).matching_statistics()
        spots = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
        for k, i in spots:
            own = texts[k]
            want = max((n for n in range(len(own) - i + 1) for b, j in spots
                        if (b, j) != (k, i) and texts[b][j:j + n] == own[i:i + n] and len(texts[b][j:j + n]) == n), default=0)
            assert ms[k][i] == want


def test_mix(docs, rows):
    got = curriculum.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    src = {(r[0], brute.n_words(r[1])): r[3] for r in rows}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + brute.n_words(r[1])
    goal = brute.targets(sizes)
    for r in got:
        s = src[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert all(0 <= p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    same(got, curriculum.mix_plan(docs).collect())
    assert curriculum.mixture(docs).columns == docs.columns


def test_schedule_inversion(spark):
    d = spark.range(101).select((F.col("id") / 100.0).alias("f"))
    for knots in (*curriculum.SCHEDULES, ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))):
        for f, x in d.select("f", curriculum._invert(F.col("f"), knots)).collect():
            area = whole = 0.0
            for (a, u), (b, v) in zip(knots, knots[1:]):
                whole += (b - a) * (u + v) / 2
                if x > a:
                    e = min(x, b)
                    area += (e - a) * (u + u + (v - u) * (e - a) / (b - a)) / 2
            assert abs(area / whole - f) < 1e-6


def test_languages(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got if r["doc_id"] in (100, 101)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"}


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination(spark, docs, rows, block):
    words = brute.TERM.findall(brute.lower(rows[3][1]))
    items = [(1, " ".join(words[2:40])), (2, "a"), (10, None), (11, ""), (12, " ".join(words[5:18]).upper()),
             (1, " ".join(words[2:40])), (13, "nowhere to be found at all"), (14, "x x x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, block_words=block).drop("n_near").collect()
    same(got, brute.contamination([(r[0], r[1]) for r in rows], items))


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(rows)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, trees=2).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_perspectives(spark):
    turns = [(1, 0, "system", "be <|im_end|> brief"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None),
             (1, None, None, "odd"), (2, 0, "system", "alone"), (None, 0, "eve", "x")]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    for size in (256, 2):
        got = perspectives.rotate(conv, part_turns=size).orderBy("conv_id", "perspective", "part").collect()
        whole = {}
        for r in got:
            at = whole.setdefault((r["conv_id"], r["perspective"]), ["", []])
            assert r["char_start"] == len(at[0])
            at[1] += [r["text"][int(a):int(b)] for a, b in (s.split(":") for s in r["spans"].split(",") if s)]
            at[0] += r["text"]
        assert set(whole) == {(1, "ann"), (1, "bob"), (None, "eve")}
        assert whole[(1, "ann")][0] == (
            "<|im_start|>user name=unknown\nodd<|im_end|>\n<|im_start|>system\nbe < |im_end|> brief<|im_end|>\n"
            "<|im_start|>assistant\nhi<|im_end|>\n" + 2 * "<|im_start|>user name=bob\n<|im_end|>\n")
        assert whole[(1, "ann")][1] == ["hi<|im_end|>"]
        assert whole[(1, "bob")][1] == 2 * ["<|im_end|>"]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[-1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def named_lines(spark, pool):
    df = spark.createDataFrame([(t,) for t in pool], "line string").select(F.xxhash64("line").alias("lid"), "line")
    return df, {r["line"]: r["lid"] for r in df.collect()}


def linked(pairs, names):
    """Each name with the smallest one that pairs connect it to."""
    root = {n: n for n in names}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in names}


@pytest.mark.parametrize("edits,hot", [(1, 16), (2, 16), (1, 1), (2, 1)])
def test_line_links(spark, edits, hot):
    rnd = random.Random(3)
    pool = sorted({"".join(rnd.choice("aé ") for _ in range(rnd.randint(3, 9))) + "b" for _ in range(80)})
    df, name = named_lines(spark, pool)
    want = {tuple(sorted((name[a], name[b]))) for i, a in enumerate(pool) for b in pool[:i] if distance(a, b) <= edits}
    got = [tuple(r) for r in lines.line_links(df.union(df), edits=edits, min_chars=4, hot=hot).collect()]
    assert set(got) <= want and len(set(got)) == len(got)
    assert linked(got, name.values()) == linked(want, name.values())
    if hot > len(pool):
        assert set(got) == want


def test_line_links_default(spark):
    """Without parameters, two edits link: two typos, a transposition, a changed two-digit number, two more letters."""
    pool = [f"the committee met on day {x} of the long session" for x in ("number 17", "number 42", "nubmer 17", "numker 18", "numbers 177", "nom 99")]
    df, name = named_lines(spark, pool)
    gap = {tuple(sorted((name[a], name[b]))): distance(a, b) for i, a in enumerate(pool) for b in pool[:i]}
    got = [tuple(r) for r in lines.line_links(df).collect()]
    assert sorted(got) == sorted(p for p, d in gap.items() if d <= 2) and sum(gap[p] == 2 for p in got) >= 3


def test_templated_lines_make_a_star(spark):
    """80 lines that differ in two digits: one class, links in proportion to the lines."""
    df, name = named_lines(spark, [f"every page of this site ends with the number {i:02d} and a very long common tail" for i in range(80)])
    got = [tuple(r) for r in lines.line_links(df).collect()]
    assert len(set(linked(got, name.values()).values())) == 1 and 79 <= len(got) <= lines.HOT * 80


def test_keys_of_lines_are_shuffled_once(spark):
    """Both readers of the keys share one exchange: the lines are exploded into keys once."""
    df, _ = named_lines(spark, [f"line {i % 7} of a text that has {i} lines in all" for i in range(40)])
    own = F.col("spot").isin([k for k, (delta, _, move) in enumerate(lines._spots(2)) if delta == move == 0])
    met = lines._met(lines._keys(df, 2), own)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("Generate") == 1


def test_long_and_short_lines(spark):
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(60_000))
    df, name = named_lines(spark, [long, long[:30_000] + "x" + long[30_000:], long[:-1] + "yy", "abc", "abd", "abcde", "xyz"])
    got = linked([tuple(r) for r in lines.line_links(df, min_chars=3).collect()], name.values())
    assert len({got[name[x]] for x in name if len(x) > 9}) == 1 and len({got[name[x]] for x in ("abc", "abd", "abcde")}) == 1
    assert got[name["xyz"]] == name["xyz"] or distance("xyz", "abc") <= 2


def test_rows_are_told_apart_by_number(spark):
    """A null id whose text is another row's id, a null text whose id is another row's text, string ids, repeated rows."""
    t = "one line that is long enough to count here " * 6
    rows = [(None, t), (t, None), ("b", t), ("b", t), (None, None), (None, None), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    same(repeats.remove_repeats(df).drop("kept").collect(), brute.repeats(rows))
    items = [(1, t)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontam.contamination(df, bench).drop("n_near").collect(), brute.contamination(rows, items))
    assert sorted(map(str, (tuple(r) for r in decontam.keep_uncontaminated(df, bench).collect()))) == sorted(
        str(r) for r in rows if not r[1])
    got = sorted(((r["doc_id"] or "", r["n_lines"], tuple(r["dropped"])) for r in lines.dedup_lines(df).collect()))
    assert got == sorted([("", 1, ()), (t, 0, ()), ("b", 1, (0,)), ("b", 1, (0,)), ("", 0, ()), ("", 0, ()), ("c", 0, ())])


def test_line_dedup(spark):
    a, b = "a line that is long enough to count", "a line that is long enough to cound"
    data = [(1, f"{a}\nother words stand here\n\n{b}"), (2, f"{b}\n{a}"), (3, None), (4, ""), (2, f"{b}\n{a}")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("lid", F.lit(1))
    got = lines.dedup_lines(df).collect()
    same([(*r[:4], tuple(r[4])) for r in got],
         [(1, 3, 2, 2, (3,)), (2, 2, 2, 2, (0, 1)), (2, 2, 2, 2, (0, 1)), (3, 0, 0, 0, ()), (4, 0, 0, 0, ())])
    kept = {r["doc_id"]: r["text"] for r in lines.drop_near_lines(df).collect()}
    assert kept[1] == f"{a}\nother words stand here\n" and kept[2] == "" and kept[3] is None


def test_shards(docs, rows):
    got = kdshard.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    same([r[:3] for r in got], want)
    assert kdshard.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks,rows_", [(5, 16384), (1, 16384), (2, 3), (5, 3)])
def test_simhash_links(spark, blocks, rows_):
    rnd = random.Random(blocks)
    prints = {0}
    for _ in range(30):
        x = rnd.getrandbits(64)
        prints |= {x, *(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(6))}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = simhash.linked_pairs(df, blocks=blocks, leaf_rows=8, shard_rows=rows_)
    from blockwise.llm.components import connected_components
    root = {r["node"]: r["root"] for r in connected_components(pairs).collect()}
    label = brute.classes(prints)
    seen = {}
    for p, k in zip(signed, label):
        assert seen.setdefault(k, root.get(p, p)) == root.get(p, p)
    assert len(set(seen.values())) == len(set(label))


def test_simhash(docs, rows):
    prints = [brute.fingerprint(r[1]) for r in rows]
    label = brute.classes(prints)
    low = {}
    for k, r in zip(label, rows):
        low[k] = min([x for x in (low.get(k), r[0]) if x is not None], default=None)
    got = simhash.simhash_classes(docs).select("doc_id", simhash.fingerprint_hex(), "component_id").collect()
    same(got, [(r[0], f"{p:016x}", low[k]) for r, p, k in zip(rows, prints, label)])
    assert simhash.keep_one(docs).count() == len(set(label))
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(i % 4 > 0)) for i, r in enumerate(rows)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    same([(*r[:6], r["base_failed"]) for r in got], [(r[0], *brute.quality_base(r[1])) for r in rows])
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.keep_quality(docs, labels).count() == sum(r["kept"] for r in got)


def test_near_copies_with_many_edits_do_not_meet(spark):
    """Lines that share long segments and differ by many characters are not
    paired; pairs within the edits are, whatever the characters."""
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    far = [(k, base[:20] + "".join(rng.choice("abcdefghijklmnop") for _ in range(14)) + base[34:]) for k in range(12)]
    near = [(20, "être à l'été où naïve señor 漢字漢字 zz"), (21, "être à l'été où naïve señor 漢字字漢 zz")]
    texts = spark.createDataFrame(far + near, "lid long, line string").withColumn("bag", lines._bag(F.col("line")))
    rows = texts.selectExpr("case when lid < 20 then 1 else 2 end as key", "lid", "0 as delta", "true as own", "false as star")
    got = [(r.a, r.b) for r in lines._pairs(lines._met_lines(rows.union(rows), texts), 2).collect()]
    assert (20, 21) in got and len(got) < 12


def test_a_line_is_split_again_only_where_its_length_allows(spark):
    """The spots of other lengths' partners are not made and dropped again."""
    rows = spark.createDataFrame([(1, 7, d, False, "abcdefghijkl") for d in range(3)], "key long, lid long, delta int, own boolean, rest string")
    plan = lines._again(rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    for d in range(3):
        made = rows.filter(F.col("delta") == d).select(F.explode(F.get(lines._tables(2), F.col("delta"))).alias("s")).select("s.*").collect()
        assert [tuple(r) for r in made] == [x for x in lines._spots(2) if x[0] == d]
    assert "= delta" not in plan and lines._again(rows, 2).filter("delta = 0").count() > 0


def test_every_link_of_a_templated_group(spark):
    """80 lines that differ in two digits, and lines whose class is a chain:
    every pair within the edits is a link, and links are counted, not classes."""
    pool = [f"every page of this site ends with the number {i:02d} and a very long common tail" for i in range(80)]
    pool += ["a chain of lines that change at their end " + x for x in ("one two", "one twoab", "one twoabcd")]
    df, name = named_lines(spark, pool)
    want = {tuple(sorted((name[a], name[b]))) for i, a in enumerate(pool) for b in pool[:i] if distance(a, b) <= 2}
    got = [tuple(r) for r in lines.line_links(df).collect()]
    assert len(got) == len(set(got)) == 80 * 79 // 2 + 2 and set(got) == want
    docs = spark.createDataFrame([(1, "\n".join(pool[:80])), (2, "\n".join(pool[80:])), (3, pool[80] + "\nno other line is anything like it")], "doc_id long, text string")
    same([(r.doc_id, r.n_lines, r.n_linked, r.n_links, len(r.dropped)) for r in lines.dedup_lines(docs).collect()],
         [(1, 80, 80, 80 * 79, 79), (2, 3, 3, 4, 2), (3, 2, 1, 1, 1)])


def test_split_groups_keep_every_link(spark):
    """Groups that are split down to single characters lose no pair."""
    rnd = random.Random(8)
    pool = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 7))) for _ in range(90)})
    df, name = named_lines(spark, pool)
    for edits in (1, 2):
        want = {tuple(sorted((name[a], name[b]))) for i, a in enumerate(pool) for b in pool[:i] if distance(a, b) <= edits}
        got = [tuple(r) for r in lines.line_links(df, edits=edits, min_chars=4, hot=1).collect()]
        assert set(got) == want and len(set(got)) == len(got)


def test_every_two_lines_of_a_large_group_meet_once(spark, monkeypatch):
    """Groups of several parts, groups reached by two keys, a group of one."""
    monkeypatch.setattr(lines, "PART", 7)
    rows = [(k, i * 1000 - 9000) for k in (1, 2) for i in range(40)] + [(3, i) for i in range(5)] + [(4, 77)]
    got = [tuple(r) for r in lines._every_two(spark.createDataFrame(rows, "key long, lid long").repartition(6)).collect()]
    groups = [{i * 1000 - 9000 for i in range(40)}, set(range(5))]
    assert sorted(got) == sorted((a, b) for g in groups for a in g for b in g if a < b)
