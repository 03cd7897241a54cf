"""Quality network, spelling variants and Merkle manifest against brute force, with the defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import merkle, quality, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, slot long, score double, bits int"


def rows_with(texts, sources=("a",)):
    """Rows of SCHEMA; the last columns have names that the operators use themselves."""
    return [(i, t, "en", sources[i % len(sources)], None if t is None else len(t), "w", 1, 2, 0.5, 3) for i, t in enumerate(texts)]


# ------------------------------------------------------------------ operator 11
def _clean(rnd):
    return " ".join(rnd.choice(["the", "river", "house", "walks", "under", "small", "green", "and", "of", "night"]) for _ in range(rnd.randint(30, 200)))


def _junk(rnd):
    return " ".join(f"{rnd.choice(['xq', 'zzk', 'wv'])}{rnd.randint(0, 9)}$$$" for _ in range(rnd.randint(30, 200)))


def test_quality_gradients_are_those_of_the_loss():
    rnd = random.Random(1)
    net = quality.Network(width=3, filters=4, hidden=3, seed=2)
    texts = [_clean(rnd).encode() * 4, b"a", _junk(rnd).encode() * 3]
    target = np.array([1, 1, 0])
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    _, grads = net.gradients(texts, target)
    for name in ("t", "c", "v", "d", "w", "b"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        was, step = net.p[name][at], 1e-5
        loss = []
        for sign in (1, -1):
            net.p[name][at] = was + sign * step
            loss.append(net.gradients(texts, target)[0])
        net.p[name][at] = was
        assert grads[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * step), rel=2e-2, abs=1e-6), name


def test_quality_chunks_cover_whole_texts():
    for n in (1, 5, quality.CHUNK - 1, quality.CHUNK, quality.CHUNK + 1, 3 * quality.CHUNK + 17):
        flat, start, filled, owner = quality.chunks([b"x" * 7, b"y" * n, b""])
        mine = owner == 1
        seen = np.zeros(n, int)
        for s, f in zip(start[mine], filled[mine]):
            assert bytes(flat[s:s + f]) == b"y" * f
            seen[s - 7:s - 7 + f] += 1
        assert seen.min() >= 1 and (owner != 2).all()


def test_quality_against_a_plain_network(spark):
    """Scores equal a position-by-position computation, and tell held-out junk from clean texts."""
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(240):
        good = rnd.random() < 0.7
        texts.append(_clean(rnd) if good else _junk(rnd))
        labels.append((i, int(good), 0))
    extra = [None, "", "x", "the river " * 20_000]
    docs = spark.createDataFrame(rows_with(texts + extra) + rows_with(texts)[:1] + [(None, "the house", *[None] * 8)], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels + [(0, None, 0), (None, 1, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    net, prior = quality.fitted(docs, marks)
    out = quality.score(docs, net, prior)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "score"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["score"])
    assert sum(map(len, got.values())) == len(texts) + len(extra) + 2 and got[0][0] == got[0][1]

    def plain(text):
        data, p = text.encode(), net.p
        if not data:
            return 0.0
        total = 0.0
        for s in range(0, max(1, len(data) - quality.CHUNK + quality.STRIDE), quality.STRIDE):
            part = data[s:s + quality.CHUNK]
            if not part or (s and s + quality.CHUNK - quality.STRIDE >= len(data)):
                break
            after = data[s + len(part):s + len(part) + 8] if len(part) == quality.CHUNK else b""
            padded = part + bytes(8)
            resp = np.array([sum(p["t"][k][padded[i + k]] for k in range(net.width)) for i in range(len(part))])
            top = np.maximum(resp.max(0) + p["c"], 0)
            total += float(np.tanh(top @ p["v"] + p["d"]) @ p["w"] + p["b"][0]) * len(part)
        size = sum(min(quality.CHUNK, len(data) - s) for s in quality_starts(len(data)))
        return total / max(quality.CHUNK, size)

    def quality_starts(n):
        return [s for s in range(0, n, quality.STRIDE) if s == 0 or s + quality.CHUNK - quality.STRIDE < n]

    for i in list(range(12)) + [240, 241, 242]:
        want = 1 / (1 + np.exp(-(prior + plain((texts + extra)[i] or ""))))
        assert got[i][0] == pytest.approx(want, abs=1e-4)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i][0] >= quality.THRESHOLD) == labels[i][1] for i in held]) >= 0.95


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame(rows_with(["a b", None]), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(k, 1, 0) for k in range(2)], none.schema)
    assert {r["score"] for r in quality.score(docs, *quality.fitted(docs, none)).collect()} == {0.5}
    scores = {r["score"] for r in quality.score(docs, *quality.fitted(docs, one)).collect()}
    assert len(scores) == 1 and 0.5 <= scores.pop() < 1
    assert quality.score(docs.limit(0), None, 0.0).count() == 0


def test_quality_never_learns_from_held_out_labels(spark):
    docs = spark.createDataFrame(rows_with(["text %d" % i for i in range(50)]), SCHEMA)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    ids = {r["doc_id"] for r in quality.learnable(docs, marks).collect()}
    assert ids == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


# ------------------------------------------------------------------ operator 12
def _edits(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 3}
    near = {w: [v for v in count if _edits(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def variant_rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abeiÀéñost") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    for w in list(words):
        k = rnd.randrange(len(w))
        words += [w[:k] + w[k + 1:], w[:k] + rnd.choice("abei") + w[k + 1:], w[:k] + "o" + w[k:], w + "s", w + "ss", w.upper()]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 3_000, "x" * 2_999]
    texts = [" ".join(rnd.choices(words, weights=[1 + 40 * (k % 17 == 0) for k in range(len(words))], k=150)) + "." for _ in range(120)]
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, "1234 -- ."), (None, texts[0]), (None, None), (5, texts[5]),
            (1003, "word9word wörterĀwörter ÀÉÎÕÜ " * 200), (1004, " ".join(["x" * 3_000, "x" * 2_999] * 3))]


@pytest.mark.parametrize("alphabets, crowded", [(spelling.ALPHABETS, spelling.CROWDED), ((2, 4, 256), 3), ((8, 256), 1), ((256,), 1)])
def test_spelling_variants(spark, alphabets, crowded):
    """Equal to comparing all pairs, also when almost every cell is too crowded and the words go on to finer alphabets."""
    rows = variant_rows()
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(docs, alphabets, crowded).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_variants(rows)


def test_spelling_without_words(spark):
    for texts in ([], [None, "", "kurz 12"], ["lonely words here"]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        out = spelling.variants(docs)
        assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_chain_of_forms(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 6), ("abcgf", 12), ("abhgf", 24), ("aihgf", 24)], "word string, n long")
    formed = spelling.forms(words, spelling.near_pairs(words))
    got = {r["word"]: (r["form"], r["n_near"]) for r in formed.collect()}
    assert got == {"abcde": ("abcdf", 1), "abcdf": ("abcgf", 2), "abcgf": ("abhgf", 2), "abhgf": (None, 2), "aihgf": (None, 1)}
    assert {(r["word"], r["root"]) for r in spelling.roots(formed).collect()} == {(w, "abhgf") for w in ("abcde", "abcdf", "abcgf")}


# ------------------------------------------------------------------ operator 13
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        lo = at - at % 3
        path.append(("".join(level[lo:at]), "".join(level[at + 1:lo + 3])))
        at //= 3
    return path


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    trees, out = {}, []
    for source, own in by_source.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[source] = levels_of([leaf_of(r, r[1]) for r in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in order])
    for source, own in by_source.items():
        for at, r in enumerate(own):
            path = path_of(trees[source], at) + path_of(top, order.index(source))
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf_of(r, r[1].replace("\n", "") if tampered else r[1])
            for pre, post in path:
                node = sha(pre, node, post)
            out.append((r[0], trees[source][0][at], trees[source][-1][0], top[-1][0], sha(*[p + q for p, q in path]), node, node == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows, tmp_dir, name):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_dir}/{name}/documents.parquet")
    got = merkle.query(spark, f"{tmp_dir}/{name}").collect()
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got)


def test_manifest_against_brute_force(spark, tmp_dir):
    rnd = random.Random(9)
    texts = [None, "", "\n", "a\nb", "long " * 9_000 + "\n"] + [f"{k}\n{rnd.random()}" * (k % 3) for k in range(2_400)]
    rows = rows_with(texts)
    # One source holds most rows (three steps of slot arrays would hold 3^18), some hold 1, 2, 3, 4 and 9 to 10 leaves.
    sized = {"Ä": 1, "é": 2, "b": 3, "B": 4, "": 9, "z一": 10, None: 28}
    at = 0
    rows = [list(r) for r in rows]
    for source, n in sized.items():
        for r in rows[at:at + n]:
            r[3] = source
        at += n
    # Ids: sparse, negative and at the ends of their range.
    for k, r in enumerate(rows):
        r[0] = (r[0] * 7_919 - 4_000_000 if k % 3 else r[0] * 10**13) if k > 5 else [-2**63, 2**63 - 1, -1, 0, 63, 64][k]
    rows = [tuple(r) for r in rows]
    assert len({r[0] for r in rows}) == len(rows)
    assert manifest_rows(spark, rows, tmp_dir, "many") == brute_manifest(rows)


def test_manifest_of_repeated_and_null_ids(spark, tmp_dir):
    base = rows_with([f"t{k}\n" for k in range(40)], sources=("a", "b", None))
    rows = base + base[:7] + [(3, "another", "en", "a", 7, *base[0][5:])] + [(None, f"n{k}\n", None, "a", None, *base[0][5:]) for k in range(5)] + [(-2**63, "m", None, "a", None, *base[0][5:])]
    assert manifest_rows(spark, rows, tmp_dir, "repeats") == brute_manifest(rows)


def test_small_manifests(spark, tmp_dir):
    one = rows_with(["only\n"])
    got = manifest_rows(spark, one, tmp_dir, "one")
    assert got == brute_manifest(one)
    (doc, leaf, subroot, root, proof, *_), = got
    assert leaf == subroot == root and proof == sha("")
    assert manifest_rows(spark, rows_with(["a", "b\n"], sources=("x", "y")), tmp_dir, "two") == brute_manifest(rows_with(["a", "b\n"], sources=("x", "y")))
    assert manifest_rows(spark, [], tmp_dir, "none") == Counter()


def test_manifest_directory_levels(spark):
    """Slots are the ranks of ids that are far apart, dense, and negative."""
    rnd = random.Random(2)
    ids = sorted({rnd.randrange(-2**62, 2**62) for _ in range(500)} | set(range(300)) | {2**40 + k * 2**22 for k in range(50)})
    rows = spark.createDataFrame([(i, "t", "x", None) for i in ids], "doc_id long, tree string, leaf string, altered string").repartition(4)
    placed, sizes = merkle.with_slots(rows)
    assert {r["doc_id"]: r["slot"] for r in placed.collect()} == {i: k for k, i in enumerate(ids)}
    assert [tuple(r) for r in sizes.collect()] == [("t", len(ids))]
