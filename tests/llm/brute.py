"""Plain Python versions of the operators, and a small corpus with every awkward case."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import xxhash

BLANK = "\x20\x09-\x0d"
WORD = re.compile(f"[^{BLANK}]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use or return, as extra columns of the input.
CLASH = ("id", "line", "size", "words", "band", "row", "block", "fingerprint", "rank", "copies", "kept", "d", "k", "n")
CLASH += ("__text", "__words", "__lines", "__windows", "__pairs", "__again", "__good", "__row", "__n_words", "__kept_chars", "__base_failed")
CLASH += ("__size", "__source", "__draw", "__copies", "__copy", "__goal", "source_size", "target")
CLASH += ("__removed", "__doc_id", "__t", "__u", "t", "u", "line_no", "removed", "column0", "column5")
CLASH += ("__fp", "__0", "__5", "__doc", "__root", "__key", "root", "shard", "component_id")


def corpus() -> list[tuple]:
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=r.randint(1, 9))) for _ in range(600)]

    def line(n):
        return " ".join(r.choices(vocab, k=n)).capitalize() + "."

    def doc(lines):
        return "\n".join(line(r.randint(4, 60)) for _ in range(lines))

    texts = [doc(r.randint(1, 6)) for _ in range(24)]
    shared, notice = line(40), "All rights reserved."
    for i in range(6):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))  # near copies
    texts += [texts[0], texts[0], texts[3]]  # exact copies
    texts += [f"{doc(1)}\n{shared}\n{doc(1)}\n{notice}" for _ in range(5)]
    texts += [None, "", " ", "\n\n", "one", "One", "1234 5678!", "a b", "Ünïcödé wörds hère.", "x" * 300, notice]
    texts += ["WORD!! " * 40, "nav | home | about | more | next | last", "same words here " * 60, "\t\x0b\x0c\r tabs\tand\x0bmore"]
    texts += [" ".join(r.choices(vocab, k=20_000)), "very " * 3000 + "long.", f"[INST] {notice} </s>"]
    rows = [(i, t, r.choice(["en", "fr", None]), f"src{r.choice([0, 0, 0, 1, 2, 3])}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[4], "en", None, 5), (None, None, None, None, None), (-9, texts[5], None, None, None)]
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"extra-{c}").alias(c) for c in CLASH])
    return df.repartition(3)


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def simhash(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    each = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(rows, bits=2):
    """(doc_id, hex fingerprint, component) per row."""
    prints = [simhash(r[1]) for r in rows]
    distinct = sorted(set(prints))
    array = np.array(distinct, dtype=np.uint64)
    pairs = [(distinct[i], distinct[j]) for i in range(len(array)) for j in np.nonzero(np.bitwise_count(array[i] ^ array) <= bits)[0]]
    root = components(distinct, pairs)
    best = {}
    for r, f in zip(rows, prints):
        if r[0] is not None:
            best[root[f]] = min(best.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", best.get(root[f])) for r, f in zip(rows, prints)]


def repeats(rows, least=50):
    """(doc_id, bytes, removed, spans, digest of the rest) per row."""
    last = 1 << 62
    seen, out = {}, []
    data = [(last if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    for d, _, b in data:
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            seen[w] = min(seen.get(w, d), d)
    for d, doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def line_shingles(line, chars=8):
    line = line.lower().ljust(chars)
    return frozenset(line[i : i + chars] for i in range(len(line) - chars + 1))


def removed_lines(rows, similar=0.8):
    """{(doc_id, text): sorted line numbers that an earlier similar line stands for}; doc_id None last.

    Rows equal in doc_id and text are one document. Of equal places in unlike texts of one doc_id,
    the operator's order by hash decides; here such ties are broken by the text's hash as there.
    """
    places = {}
    for r in rows:
        text = r[1] or ""
        for i, line in enumerate(text.split("\n")):
            if WORD.search(line):
                places.setdefault(line, set()).add((r[0] is None, r[0] or 0, i, _spark_hash(text), text))
    sets = {line: line_shingles(line) for line in places}
    index = {}
    for line, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(line)
    pairs = []
    for line, s in sets.items():
        common = Counter(o for x in s for o in index[x])
        pairs += [(line, o) for o, n in common.items() if o > line and 10 * n >= round(10 * similar) * (len(s) + len(sets[o]) - n)]
    root = components(list(places), pairs)
    groups = {}
    for line, at in places.items():
        groups.setdefault(root[line], set()).update(at)
    gone = {}
    for at in groups.values():
        for none, doc, i, *_, text in at - {min(at)}:
            gone.setdefault((None if none else doc, text), set()).add(i)
    return {key: sorted(at) for key, at in gone.items()}


def _spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def order_minhash(text, k=2, bins=64):
    words = WORD.findall(text)
    empty = "...."
    if not words:
        return empty * bins
    grams = [_spark_hash(*words[i : i + k]) >> 24 for i in range(max(1, len(words) - k + 1))]
    seen, numbered = Counter(), []
    for i, h in enumerate(grams):
        numbered.append((_spark_hash(h, seen[h]) >> 24, i))
        seen[h] += 1
    least = {}
    for x in sorted(numbered):
        least.setdefault(x[0] >> 34, x)
    chosen = sorted(least.values())
    out = {}
    for n, x in enumerate(chosen):
        y = chosen[(n + 1) % len(chosen)]
        a, b = (x, y) if x[1] <= y[1] else (y, x)
        out[x[0] >> 34] = f"{_spark_hash(a[0], b[0]) & 0xFFFF:04x}"
    return "".join(out.get(b, empty) for b in range(-bins // 2, bins // 2))


def likeness(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    filled = sum(x != "...." or y != "...." for x, y in pairs)
    return sum(x == y != "...." for x, y in pairs) / filled if filled else 1.0
