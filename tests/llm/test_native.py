"""Mixing, quality rules, order MinHash and line dedup against DuckDB or plain Python."""

import hashlib
import os
import random
import re
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from revlens.llm import fingerprint, lines, mixing, quality
from revlens.llm.common import cut
from revlens.llm.components import components
from revlens.session import SHUFFLE_CLEANUP, checkpoint_dir, shuffles_deleted
from tests.llm import brute


def duck(rows, sql):
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("documents", table)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return Counter(tuple(_norm(v) for _, v in sorted(zip(names, r))) for r in out.fetchall())


def spark_rows(df):
    return Counter(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.mark.parametrize("op, sql", [(mixing.plan, mixing.SQL), (quality.judge, quality.SQL)])
def test_equals_sql(spark, rows, op, sql):
    assert spark_rows(op(brute.frame(spark, rows))) == duck(rows, sql)


@pytest.mark.parametrize("op", [mixing.plan, mixing.mix, quality.judge, quality.clean, lines.marked, lines.dedup, fingerprint.edited, fingerprint.fingerprints])
def test_empty_table(spark, op):
    assert op(brute.frame(spark, [])).collect() == []


def test_mix_emits_what_the_plan_says(spark, rows):
    df = brute.frame(spark, rows)
    assert mixing.mix(df).columns == df.columns
    made = Counter((r.doc_id, r.text) for r in mixing.mix(df).collect())
    again = Counter((r.doc_id, r.text) for r in mixing.mix(df).collect())
    want = Counter()
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in mixing.plan(df).collect():
        assert r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
        if r.doc_id is not None:
            want[(r.doc_id, texts[r.doc_id])] += r.copies
    made_known = Counter({k: n for k, n in made.items() if k[0] is not None})
    assert made_known == +want and made == again


def test_targets_share_out_all(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), ("d", 3), (None, 80)]
    rows = [(i, "w " * n, None, s, None) for i, (s, n) in enumerate(sizes)]
    got = {r.source: (r.source_size, r.target) for r in mixing.plan(brute.frame(spark, rows)).collect()}
    assert sum(t for _, t in got.values()) == pytest.approx(1.5 * sum(n for _, n in sizes))
    assert all(t <= 2 * n for n, t in got.values()) and got["b"][1] == 20 and got["d"][1] == 6


def test_clean_drops_bad_lines_and_documents(spark):
    good = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [
        (1, f"{good}\nhome | about | contact | more\nAll rights reserved.\nSecond line, here too.", None, None, 1),
        (2, good + "\n" + "BUY!! NOW!! CHEAP!! " * 60, None, None, 1),
        (3, None, None, None, None),
        (4, "too short.", None, None, 1),
    ]
    df = brute.frame(spark, rows)
    out = quality.clean(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    text = f"{good}\nSecond line, here too."
    assert got == [(1, text, len(text))]


def test_lines_in_other_scripts_and_whole_words(spark):
    words = " ".join(f"shabd{i}" for i in range(25))
    kept = [
        "यह एक साफ़ हिन्दी वाक्य है जिसमें बीस से अधिक शब्द हैं ताकि नियम इसे छोटा न समझे और पूरा रखे जाने योग्य माने तथा हटाए नहीं।",
        "هل هذا نص عربي واضح يحتوي على أكثر من عشرين كلمة حتى لا تعتبره القاعدة قصيرا جدا وترفضه من دون سبب وجيه أو مفيد لنا؟",
        "ይህ ንጹህ ጽሑፍ ነው ከሃያ በላይ ቃላት አሉት ስለዚህ ደንቡ አጭር ነው ብሎ አይጥለውም እና ሙሉ በሙሉ ይቀመጣል ምክንያቱም ምልክት ስላለው ነው ሁሉም ጥሩ ናቸው።",
        " ".join(f"คำ{i}" for i in range(10)) + " ภาษา ไทย " + "ที่ ไม่ มี เครื่องหมาย จบ ประโยค อยู่ เลย ใน บรรทัด นี้",
        f"{words} \u0e2a",
        "The cataloging and design increments of this presubscribed set belong to javascripted notes about precookies and more words to fill it up well.",
    ]
    gone = [words, "Please read more of it now: click here to go on to the next of these many pages that we have all over the whole site."]
    rows = [(i, t, None, None, None) for i, t in enumerate(kept + gone)]
    got = {r.doc_id: r.kept for r in quality.judge(brute.frame(spark, rows)).collect()}
    assert got == {i: i < len(kept) for i in range(len(rows))}


def test_lines_equal_brute_force(spark, rows):
    want = brute.removed_lines(rows)
    df = brute.frame(spark, rows)
    found = lines.marked(df).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, tuple(r.removed)) for r in found) == Counter((r[0], tuple(want.get((r[0], r[1] or ""), []))) for r in rows)
    assert all(r.n_removed == len(r.removed) for r in found)
    out = lines.dedup(df)
    assert out.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    expect = Counter()
    for r in rows:
        gone = set(want.get((r[0], r[1] or ""), []))
        text = r[1] if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        expect[(r[0], text)] += 1
    assert left == expect


def test_lines_are_judged_by_every_position(spark):
    unlike = [
        "https://example.com/products/red-shoes",
        "https://other.org/contact",
        "2024-05-01T10:00:00,4711,open,north",
        "2024-05-01T17:31:26,8,paid,south-east",
        "这是一个关于天气的句子今天下雨了我们在家里读书",
        "这是一个关于天气报告里没有的山和海边的故事",
    ]
    alike = ["=" * 12, "=" * 40]  # equal sets
    lone = [(i, x, None, None, None) for i, x in enumerate(unlike + alike)]
    got = {r.doc_id: r.n_removed for r in lines.marked(brute.frame(spark, lone)).collect()}
    assert [got[i] for i in range(len(unlike))] == [0] * len(unlike)
    assert got[6] == 0 and got[7] == 1


def test_lines_of_one_hot_family(spark):
    base = [f"word{i:03d}" for i in range(60)]
    rows = []
    for i in range(300):  # alike in all but one word
        words = list(base)
        words[i % 60] = f"other{i}"
        rows.append((i, " ".join(words) + ".", None, None, None))
    got = lines.marked(brute.frame(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 299 and {r.doc_id for r in got if not r.n_removed} == {0}


def test_rows_of_null_or_one_id_lose_their_own_lines(spark):
    own = ["alpha beta gamma delta.", "epsilon zeta eta theta.", "iota kappa lambda my.", "ny xi omikron pi rho."]
    shared, after = "sigma tau ypsilon phi chi.", "psi omega aleph beth gimel."
    texts = [f"{own[0]}\n{after}", f"{shared}\n{own[1]}", f"{shared}\n{own[2]}", f"{own[3]}\n{shared}"]
    for doc in (None, 5):
        docs = brute.frame(spark, [(doc, t, None, None, None) for t in texts] + [(1, shared, None, None, None)])
        got = Counter(r.text for r in lines.dedup(docs).collect())
        assert got == Counter([texts[0], own[1], own[2], own[3], shared])
        assert sum(r.n_removed for r in lines.marked(docs).collect()) == 3
    # equal lines at one line number of two rows: one of them goes
    docs = brute.frame(spark, [(None, t, None, None, None) for t in texts[1:3]])
    assert sum(r.n_removed for r in lines.marked(docs).collect()) == 1


@pytest.mark.parametrize("few", [lines.FEW, 2])
def test_lines_that_resemble_only_one_of_a_family(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)
    base = [f"word{i:03d}" for i in range(60)]

    def changed(words, at, n, name):
        return [f"{name}{i % 60:03d}" if (i - at) % 60 < n else w for i, w in enumerate(words)]

    family = [changed(base, 2 * i, 2, f"f{i:03d}") for i in range(140)]
    strangers = [changed(family[i], 2 * i + 20, 4, f"s{i:03d}") for i in range(40)]  # 0.85 like family[i], 0.78 at most like others
    rows = [(i, " ".join(x) + ".", None, None, None) for i, x in enumerate([base, *family, *strangers])]
    assert len(brute.removed_lines(rows)) == len(rows) - 1
    got = lines.marked(brute.frame(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {0}


def test_prefixes_lose_no_similar_pair_and_spare_the_others(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    base = r.choices(words, k=40)
    texts = set()
    for i in range(250):  # one base with more and more of its words changed, and lines that share nothing
        line = list(base) if i % 5 else r.choices(words, k=r.randint(1, 50))
        for at in r.sample(range(len(line)), min(len(line), i % 7)):
            line[at] = r.choice(words) + r.choice(words)
        texts.add(" ".join(line))
    texts = sorted(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = table.withColumn("n", F.size(F.array_distinct(lines.shingles(F.col("line")))))
    prefix = lines._prefixes(sets, table.select("id"), 0.8).select("id", "s")
    met = {(x.id, x.a) for x in prefix.join(prefix.withColumnRenamed("id", "a"), "s").where("id < a").select("id", "a").distinct().collect()}
    sets = [brute.line_shingles(t) for t in texts]
    like = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])}
    touching = sum(bool(sets[i] & sets[j]) for j in range(len(sets)) for i in range(j))
    assert len(like) > 50 and like <= met and len(met) < touching / 3
    # the meetings left to the exact check, every line in one bucket and some in a second and third: no similar pair is lost
    buckets = table.selectExpr("id", "explode(array(0, if(id % 2 = 0, 1, 0), if(id % 3 = 0, 2, 0))) AS band").distinct()
    sizes = table.withColumn("n", F.size(F.array_distinct(lines.shingles(F.col("line")))))
    roots, compared = spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "id long, a long")
    pairs, _ = lines._unjoined(buckets, roots, compared, sizes, 0.8)
    pairs = [(x.id, x.a) for x in pairs.collect()]
    assert len(pairs) == len(set(pairs)) and like <= set(pairs) and len(pairs) < len(met)


def test_lines_run_no_python(spark, rows, monkeypatch):
    frame = type(spark.range(0))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.delattr(frame, name)
    assert lines.marked(brute.frame(spark, rows[:20])).count() == 20


def test_bands_equal_plain_minhash(spark):
    r = random.Random(6)
    texts = ["".join(r.choices("abcdef é", k=n)) for n in (900, 400, 400)] + ["One short line.", "x", "ab" * 50]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    got = {x.id: x.bands for x in lines.with_bands(table, "id").collect()}
    for i, text in enumerate(texts):
        least = {}
        for h in map(brute._spark_hash, brute.line_shingles(text)):
            j = (h + (1 << 63)) // lines._WIDTH
            least[j] = min(h, least.get(j, h))
        rows = [next((least[o] for o in others if o in least), min(least.values())) for others in lines._OTHERS]
        keys = [F.xxhash64(F.lit(k), *[F.lit(rows[k + n * lines.BANDS]) for n in range(lines.ROWS)]) for k in range(lines.BANDS)]
        assert got[i] == list(spark.range(1).select(*keys).first())


def test_sketches_differ_by_no_more_than_the_shingles(spark):
    r = random.Random(8)
    base = "".join(r.choices("abcdefgh ", k=400))
    texts = ["x", "short é", "ab" * 300, base, *[base[:i] + "changed" + base[i + 7 :] for i in range(0, 400, 20)], base[::-1], base[:200]]
    got = {x.id: x for x in lines.sketches(spark.createDataFrame(list(enumerate(texts)), "id long, line string")).collect()}
    sets = [brute.line_shingles(t) for t in texts]
    assert [got[i].n for i in range(len(texts))] == [len(x) for x in sets]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differ = sum(((got[i][w] ^ got[j][w]) & (1 << 64) - 1).bit_count() for w in lines.SKETCH)
            assert differ <= len(x ^ y) and differ % 2 == len(x ^ y) % 2
            assert bool(differ) == (x != y)


@pytest.mark.parametrize("few", [lines.FEW, 2])
def test_pairs_of_a_bucket_that_are_not_quite_similar_do_not_meet(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)
    r = random.Random(9)
    base = ["".join(r.choices("abcdefghij", k=6)) for _ in range(40)]
    texts = []
    for i in range(140):  # each lacks four words of the base and has others that a third of the lines share
        line = list(base)
        for at in r.sample(range(40), 4):
            line[at] = f"other{i % 3}{at}"
        texts.append(" ".join(line))
    texts = sorted(set(texts))
    sets = [brute.line_shingles(t) for t in texts]
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sizes = table.withColumn("n", F.size(F.array_distinct(lines.shingles(F.col("line")))))
    roots, compared = spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "id long, a long")
    pairs, _ = lines._unjoined(table.selectExpr("id", "0L AS band"), roots, compared, sizes, 0.8)
    pairs = {(x.id, x.a) for x in pairs.collect()}
    similar = {p for p, x in like.items() if x >= 0.8}
    near = {p for p, x in like.items() if 0.5 <= x < 0.75}
    assert similar <= pairs and len(near) > 4000 and len(pairs & near) < len(near) / 10


def _shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return set(re.findall(r"shuffle_(\d+)_", blocks.mkString(" ")))


def test_written_tables_leave_no_shuffle_files(spark):
    before, kept = _shuffles(spark), spark.conf.get(SHUFFLE_CLEANUP)
    with shuffles_deleted(spark):  # one write inside another
        table = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-groups")
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    until = time.time() + 10
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == kept
    assert sum(x["count"] for x in table.collect()) == 1000


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)], "a long, b long")
    roots = components(edges, "a", "b", "test-one-table")
    left = os.listdir(checkpoint_dir(spark).removeprefix("file:") + "/llm")
    assert len([x for x in left if x.startswith("test-one-table")]) == 1
    assert {x.root for x in roots.collect()} == {0} and roots.count() == 61


def test_buckets_are_made_a_few_bands_at_a_time(spark, rows, monkeypatch):
    tables, first = [], lines.cut

    def spy(df, name):
        out = first(df, name)
        if name == "lines-buckets":
            tables.append({r.k for r in out.select("k").distinct().collect()})
        return out

    monkeypatch.setattr(lines, "cut", spy)
    lines.removals(brute.frame(spark, rows))
    assert [k for t in tables for k in sorted(t)] == list(range(lines.BANDS))
    assert max(map(len, tables)) < lines.BANDS


def test_fingerprints_equal_brute_force(spark, rows):
    low = -(1 << 63)
    order = sorted(
        rows, key=lambda r: (-(low if r[0] is None else r[0]), brute._spark_hash(r[1] or ""))
    )
    want = Counter()
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = (brute.order_minhash(x) for x in (text, edit, after))
        digest = hashlib.sha256(edit.encode()).hexdigest()
        want[(r[0], len(text), digest, a, b, round(brute.likeness(a, b), 6), round(brute.likeness(a, c), 6))] += 1
    got = Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 6), round(r.near_next, 6))
        for r in fingerprint.edited(brute.frame(spark, rows)).collect()
    )
    assert got == want


def test_order_counts_in_a_fingerprint(spark):
    a = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(a), None, None, None), (1, " ".join(a[200:] + a[:200]), None, None, None), (2, " ".join(a), None, None, None)]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(brute.frame(spark, rows)).collect()}
    assert got[0] == got[2] and 0.2 < brute.likeness(got[0], got[1]) < 0.8
