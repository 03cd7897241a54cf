"""Every training-data operator against a brute-force version, with the defined edge cases."""

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import byte_bpe, decontamination, html_text, jaccard_join, language, licenses, sharding, token_counts, vector_dedup, warc

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, label string"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def some_docs():
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bdkÄé" for b in ("an", "or", "is", "ue7")]
    base = " ".join(rnd.choice(vocabulary) for _ in range(120))
    near = base.split(" ")
    texts = [base, base, base.upper(), None, None, "", "  \n", "one", "one two three four", "Released under the MIT License. see CC BY-NC 4.0!",
             "apache license apache license, version 2.0; GNU General Public License", "x " * 20_000, "é" * 3_000 + " ende"]
    texts += [" ".join([*near[:k], "zz", *near[k + 1:]]) for k in range(3, 110, 9)]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200))) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t or ""), "w", "l") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shards(docs, empty):
    got = sharding.balanced_shards(docs, 5).orderBy("global_row").collect()
    want = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, *_ in some_docs()))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in got] == want
    total, start, slots = sum(w[3] for w in want), 0, {}
    for r in got:
        assert r["start"] == start and r["shard"] == min(4, (2 * start + r["size"]) * 5 // (2 * total))
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        start += r["size"]
    assert sharding.balanced_shards(empty).count() == 0


@pytest.mark.parametrize("most", [100_000, 1])
def test_decontamination(spark, docs, empty, most):
    texts = {i: t for i, t, *_ in some_docs() if i is not None}
    items = [(1, " ".join(words(texts[0])[10:40])), (2, "One two, THREE"), (3, None), (4, ""), (None, "é" * 3_000), (1, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(item)
    marked = decontamination.mark(docs, bench, max_broadcast=most).select("_row.doc_id", "_row.text", "_n_words", "_n_hit")
    want = []
    for i, t, *_ in some_docs():
        w, hit = words(t), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
        want.append((i, t, len(w), len(hit)))
    assert rows_of(marked) == sorted(want, key=repr)
    kept = decontamination.decontaminate(docs, bench, max_broadcast=most)
    assert kept.columns == docs.columns
    assert rows_of(kept.select("doc_id", "text")) == sorted([(i, t) for i, t, n, h in want if not (h and 20 * h >= n)], key=repr)
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, remove="spans", max_broadcast=most).collect()}
    assert cut[8] == "four" and cut[5] == "" and cut[3] is None and len(words(cut[0])) == 90
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.decontaminate(empty, bench).count() == 0


def brute_licenses(text):
    w = words(text)
    base = {label: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
    norm, found = " ".join(w), []
    for n, r in enumerate(licenses.rules()):
        for m in re.finditer(r["pattern"], norm):
            s = norm[:m.start()].count(" ")
            found.append((s, -(s + m[0].count(" ") + 1), r["priority"], n, r["label"], r["score"]))
    # (start, -end, priority, rule, label, score): inside one of the same or a better priority; then around one of a better one.
    inside = lambda d, k: k[0] <= d[0] and k[1] <= d[1] and k is not d and (k[:2] != d[:2] or k[2:4] < d[2:4])
    left = [d for d in found if not any(inside(d, k) and k[2] <= d[2] for k in found)]
    kept = [d for d in left if not any(inside(k, d) and k[2] < d[2] for k in left)]
    return len(w), base, [(d[0], -d[1], d[4]) for d in sorted(kept, key=lambda d: (d[0], -d[1], d[2], d[3]))]


def test_licenses_of_very_long_texts(spark):
    """Time follows the number of matches: 20,000 in one text within seconds; crossing intervals stay, contained ones go."""
    import time

    few, many = "mit license and ", 20_000
    df = spark.createDataFrame([(0, few * 2_500), (1, few * many)], "doc_id long, text string")
    seconds = []
    for k in (0, 1):
        t0 = time.time()
        row = licenses.detect(df.filter(F.col("doc_id") == k)).first()
        seconds.append(time.time() - t0)
        assert len(row["detections"]) == (2_500, many)[k] and row["detections"][-1]["s"] == 3 * (len(row["detections"]) - 1)
    assert seconds[1] < 30
    table = [{"rule": f"r{k}", "label": label, "priority": p, "score": 1.0, "gate": [["gpl"]], "pattern": f"(?<![^ ]){body}(?![^ ])"}
             for k, (label, p, body) in enumerate([("outer", 4, "a b c d"), ("inner", 4, "b c"), ("cross", 4, "c d e"), ("better", 2, "g"), ("around", 3, "f g h"), ("same", 4, "a b c d")])]
    one = spark.createDataFrame([(0, "gpl a b c d e f g h")], "doc_id long, text string")
    assert [d["label"] for d in licenses.detect(one, rule_table=table).first()["detections"]] == ["outer", "cross", "better"]


def test_licenses(spark, docs, empty):
    assert len(licenses.rules()) > 200 and len({r["rule"] for r in licenses.rules()}) == len(licenses.rules())
    texts = [t for _, t, *_ in some_docs()] + [
        "SPDX-License-Identifier: Apache-2.0", "This work is licensed under the GNU General Public Licence, version 3. All rights reserved.",
        "mit license " * 40, "cc-by cc by-sa 4.0 CC BY", "This software is released under the terms of the BSD 3-clause license",
        "Permission is hereby granted, free of charge; copyright (c) 2020 2021", "mit einer Lizenz",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "you may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.detect(df).collect():
        n, base, kept = brute_licenses(r["text"])
        assert r["n_words"] == n and {b["label"]: list(b["places"]) for b in r["base"]} == base
        assert [(d["s"], d["e"], d["label"]) for d in r["detections"]] == kept, r["text"]
    assert licenses.detect(empty).count() == 0
    assert set(docs.columns) - {"w"} <= set(licenses.detect(docs).columns)


def forms(tree, rnd):
    """Every part of a parsed pattern in each of its alternatives, other parts at random: the texts a pattern matches."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            ways = [chr(arg)]
        elif op == "IN":
            ways = [chr(k) for kind, x in arg for k in ([x] if str(kind) == "LITERAL" else [x[0]] if str(kind) == "RANGE" else [ord("4")])]
        elif op == "BRANCH":
            ways = [w for way in arg[1] for w in forms(way, rnd)]
        elif op == "SUBPATTERN":
            ways = forms(arg[-1], rnd)
        elif op == "MAX_REPEAT":
            ways = ([""] if arg[0] == 0 else []) + forms(arg[2], rnd)
        else:
            assert op == "ASSERT_NOT", op
            ways = [""]
        longest = max(len(out), len(ways))
        rnd.shuffle(out)
        out = [a + b for a in out for b in ways] if len(out) * len(ways) <= 40 else [out[k % len(out)] + ways[k % len(ways)] for k in range(longest)]
    return out


def test_license_gates(spark):
    """Each gate opens for every form of its rule's pattern; what comes out equals the rules without gates."""
    from re import _parser

    rnd, texts = random.Random(0), ["Released under the GPLv3", "GPLv2 or later", "gpl3", "Zero-Clause BSD", "Expat License", "Berkeley Software Distribution License",
                                    "FreeBSD Licence", "for noncommercial use", "for non-commercial use only"]
    for r in licenses.rules():
        made = sorted(set(forms(_parser.parse(r["pattern"]), rnd)))
        assert made and all(re.search(r["pattern"], text) for text in made)
        for text in made:
            keys = set(text.replace("licence", "license").split(" "))
            assert any(keys.issuperset(way) for way in r["gate"]), (r["rule"], text)
        texts += rnd.sample(made, 1)
    for r in licenses.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert [(d["s"], d["e"], d["label"]) for d in r["detections"]] == brute_licenses(r["text"])[2] != [], r["text"]


def test_byte_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t, *_ in some_docs():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for sizes in ({}, {"chunk": 70, "overlap": 9}):  # the long runs of one letter cover many overlaps
        assert rows_of(byte_bpe.digests(docs, path, P.PATTERN, **sizes)) == sorted(want, key=repr)
    assert byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).filter("doc_id = 8").first()["decoded"] == b"one two three four"
    assert byte_bpe.digests(empty, path, P.PATTERN).count() == 0


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [(900, "a<|endoftext|>B ΑΣ İ ǅ x\u0085'S don't 12３ — ﬁ é", *[None] * 5)]
    df = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, *_ in some_docs() + odd]
    assert rows_of(token_counts.token_counts(df, path, 7)) == sorted(want, key=repr)
    assert token_counts.token_counts(empty, path).count() == 0


def brute_jaccard(rows):
    sets = {}
    for k, (i, t, *_) in enumerate(rows):
        w = words(t)
        if w:
            sets[k] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))
    links = {k: [m for m in sets if m != k and 10 * len(sets[k] & sets[m]) >= 8 * len(sets[k] | sets[m])] for k in sets}
    return sets, links


def test_jaccard(docs, empty):
    rows = some_docs()
    sets, links = brute_jaccard(rows)
    got = jaccard_join.similar_texts(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((rows[k][0], len(links[k])) for k in links), key=repr)
    assert sorted(((r["doc_id"], r["n_links"]) for r in got if r["text_key"] and (words_of := words(dict((a, b) for a, b, *_ in rows)[r["doc_id"]] if r["doc_id"] is not None else "one"))), key=repr) == want
    group = {}
    for k in sets:  # components
        group[k] = k
    for k in sets:
        for m in links[k]:
            a, b = group[k], group[m]
            for x in group:
                if group[x] == b:
                    group[x] = a
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(bool(words(t)) for t in texts) == len(set(group.values()))
    assert sum(not words(t) for t in texts) == sum(not words(t) for _, t, *_ in rows)
    assert jaccard_join.similar_texts(empty).count() == 0


def test_prefix_depth():
    assert jaccard_join.prefix_depth(0.8, recall=0.5) == jaccard_join.LABEL
    assert jaccard_join.prefix_depth(0.8) == 3 and jaccard_join.prefix_depth(0.1) == 1


@pytest.mark.parametrize("block", [1_024, 7])
def test_vectors(spark, block):
    rng = np.random.default_rng(0)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.13).tolist(), 1) for i in range(120)]  # a dense group, larger than the window
    rows += [(200 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    rows += [(300, rows[0][1], 1), rows[1], (None, rows[2][1], 1), (301, rows[0][1], None), (302, [0.0] * 16, 1), (303, None, 1),
             (304, [float("nan")] * 16, 1), (305, [None] * 16, 1), (306, [], 1), (307, rows[0][1][:8], 1), (308, (np.array(rows[0][1]) * 1e200).tolist(), 1)]
    got = vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=16, block=block).collect()
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    near = {k: [m for m in ok if m != k and rows[m][2] == rows[k][2] and len(unit[m]) == len(unit[k]) and unit[m] @ unit[k] >= 0.98] for k in ok}
    want = sorted(((rows[k][0], len(near.get(k, ()))) for k in range(len(rows))), key=repr)
    assert sorted(((r["vec_id"], r["n_links"]) for r in got), key=repr) == want
    whole = {r["vec_id"]: r["component_id"] for r in got}
    assert whole[302] == 302 and whole[300] == whole[0] == whole[308]
    assert vector_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_with_a_shared_mean(spark):
    """Pairs at 0.981 in one label whose unrelated vectors have a cosine of 0.9, by passes, against brute force."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.9) * unit(rng.normal(size=48)) + np.sqrt(0.1) * unit(rng.normal(size=(9_000, 48))))
    side = rng.normal(size=(1_000, 48))
    side = unit(side - (side * x[:1_000]).sum(1, keepdims=True) * x[:1_000])
    x = np.concatenate([x, 0.981 * x[:1_000] + np.sqrt(1 - 0.981 ** 2) * side])
    want = [int((x[k:k + 1] @ x.T >= 0.98).sum()) - 1 for k in range(len(x))]
    assert sum(want) >= 2_000 and 16 <= vector_dedup.schedule(len(x), 0.1)[0] < vector_dedup.schedule(400_000, 0.1)[0]
    assert vector_dedup.schedule(2, 0.5) == (16, 64, 32) and vector_dedup.schedule(10**6, 1e-9)[0] == vector_dedup.MOST_PASSES
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.link_vectors(df).collect()}
    # No link too many, and of the planted ones 99 % at least.
    assert all(got[k] <= want[k] for k in range(len(x))) and sum(got.values()) >= 0.99 * sum(want)


def test_vectors_by_passes(spark, monkeypatch):
    """The passes themselves: windows over partition edges, and a run of one number in blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)) + 2
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, 24)) * 0.02, x[:1] + rng.normal(size=(90, 24)) * 0.01])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.98).sum(1) - 1).tolist()
    monkeypatch.setattr(vector_dedup, "schedule", lambda *a: (40, 32, 40))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.link_vectors(df.repartition(3), window=32, block=40).collect()}
    assert [got[k] for k in range(len(x))] == want


def test_language(spark, empty):
    rnd = random.Random(1)
    parts = {"xx": ["ka", "ko", "ri"], "yy": ["sch", "ung", "eit"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[l]) for _ in range(3)) for _ in range(30)), l) for i in range(120) for l in [rnd.choice("xy") * 2]]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 -- 3", "xx"), (None, rows[0][1], None), (503, rows[0][1] * 300, None), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, net = language.fitted(df)
    got = language.predict(df, languages, net).withColumn("held", language.held_out(F.col("doc_id"))).collect()
    assert languages == ["xx", "yy"] and len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (None, 503)} == {rows[0][2]}
    assert not any(r["held"] for r in got if r["doc_id"] is None)
    nothing = language.predict(df.drop("lang"), *language.train([])).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert language.predict(empty.select("doc_id", "text"), languages, net).count() == 0


def test_gradient_by_differences():
    net = language.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, filled, target = np.random.default_rng(0).integers(97, 105, (6, 5)), np.array([6, 6, 3, 1, 5]), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(codes, filled, target)
    for k, at in (("x", (1, 99, 7)), ("u", (0, 2, 9)), ("u", (1, 3, 1)), ("o", (5, 2)), ("b", (1,))):
        ends = []
        for step in (1e-3, -2e-3):
            net.p[k][at] += step
            ends.append(net.gradients(codes, filled, target)[0])
        net.p[k][at] += 1e-3
        assert abs((ends[0] - ends[1]) / 2e-3 - grads[k][at]) < 1e-5


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body>{body}"


def test_html(spark):
    tree = [(k, "http://h.example/x", page(f"<div class='top9'>Always the same</div><div class='story'><p>Story {k} is here<p>and goes &amp; on</div>"), "e") for k in range(9)]
    odd = [(50, None, None, "e"), (51, "x", "", "e"), (52, "http://h.example/y", tree[0][2], "e"),
           (53, "http://o.example/", page("<nav>menu</nav><header>head</header><article><h1>A&nbsp;b</h1>\n<p>one<b>two</b>\n three<br>four<ul><li>x<li>y</ul>"
                                          "<div class='comments'><p>me</p></div><form>f</form><aside>s</aside></article><p>after</p><footer>foot</footer></body>"), "e"),
           (54, "http://o.example/", "<article><p title='a>b'>cut <!-- off", "e"), (55, "http://o.example/", "<div>" * 3_000 + "deep", "e"),
           (56, "http://o.example/", "<p>a < b <3 " + "<i" , "e")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(tree + odd, "page_id long, url string, html string, host string").repartition(3)).collect()}
    for k in range(9):
        assert got[k]["text"] == f"Story {k} is here\nand goes & on" and got[k]["host"] == "e"
    assert (got[50]["text"], got[50]["n_chars"]) == (got[51]["text"], 0) == ("", 0)
    assert got[53]["text"] == "A b\nonetwo three four\nx\ny" and got[53]["n_chars"] == len(got[53]["text"])
    assert got[54]["text"] == "cut" and got[55]["text"] == "deep" and got[56]["text"].startswith("a < b")
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_tree_of_whole_pages(spark):
    """The tree holds the blocks around an article too, and its importances take branches out before any HTML rule."""
    made = [(k, "http://h.example/x", page(f"<nav><ul><li><a href='/a'>The menu</a></ul></nav><div class='x'>Same advert</div><article><h1>Title {k}</h1><h2>Intro</h2>"
                                           f"<p>Story {k}</p><p>The end</p><div class='box'>Read us daily</div></article><footer>Foot</footer>")) for k in range(9)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    tree = {r["node"]: r for r in html_text.node_importance(pages).collect()}
    gone = {n for n, r in tree.items() if r["judged"] and r["importance"] < html_text.LEAST}
    read = html_text.Page(made[0][2])
    lost = [text for text, chain, *_ in read.blocks if not gone.isdisjoint(chain)]
    assert lost == ["The menu", "Same advert", "Read us daily", "Foot"]
    assert all(n in tree for _, chain, *_ in read.blocks for n in chain) and all(r["pages"] == 9 for r in tree.values())
    assert {r["text"] for r in html_text.main_text(pages).collect()} == {f"Title {k}\nIntro\nStory {k}\nThe end" for k in range(9)}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/pages.parquet"), reason="no given pages")
def test_html_tree_on_given_pages(spark):
    """Every block of the given pages is in the tree, and what surrounds the articles is less important than they are.
    No menu, advert or footer there is on more than a few pages of its host, so a bound has to be high to take them out."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    tree = {(r["host"], r["node"]): r for r in html_text.node_importance(pages).collect()}
    assert tree
    bound, surrounding, articles, removed = 0.95, [], [], 0
    for r in html_text.hosted(pages).collect():
        read = html_text.Page(r["html"] or "")
        for text, chain, _, article, _ in read.blocks:
            rows = [tree[r["host"], n] for n in chain]
            (articles if article else surrounding).append(rows[2]["importance"])
            gone = any(x["judged"] and x["importance"] < bound for x in rows)
            assert not (gone and article)
            removed += gone
    assert removed > 1_000 and np.mean(surrounding) < np.mean(articles)


@pytest.mark.parametrize("body, want", [
    ("<body class='single-post comments-open'><p>Story</p>", "Story"),
    ("<body class='cookie comments'><article><p>Story</p></article>", "Story"),
    ("<article class='post has-comments comments'><p>Story</p></article>", "Story"),
    ("<div class='share'><article><p>Story</p></article></div>", "Story"),
    ("<div class='widget social'><main><p>Story</p></main></div>", "Story"),
    ("<form id='aspnetForm'><article><p>Story</p><form>f</form></article></form>", "Story"),
    ("<article><div class='entry-content share-enabled'><p>Story</p></div></article>", "Story"),
    ("<article><h2 id='related-work'>Related work</h2><h2 class='header'>H</h2><p class='notice'>Story</p></article>", "Related work\nH\nStory"),
    ("<article><div class='header'><h1>H</h1></div><section id='social-history'><p>Story</p></section><section id='notices'><p>N</p></section></article>", "H\nStory\nN"),
    ("<article><p>Story</p><div class='ad-2'>a</div><div class='x Comments'>c</div><div id='comments'>d</div></article>", "Story"),
    ("<article><p>Story</p></article><div id='comments'><article>A comment</article></div><div class='widget'><article>w</article></div>", "Story"),
    ("<main><div class='comments'>c</div><p>Story</p></main>", "Story"),
    ("<div class='sidebar'>s</div><div class='promo'>a</div><p>Story</p>", "Story"),
])
def test_html_names(body, want):
    assert "\n".join(text for text, _ in html_text.Page(page("") + body).main()) == want


def test_warc(spark, tmp_dir):
    pages = spark.createDataFrame([(1, "http://a.example/", "<title>T</title><p>x <a href='/l?a&amp;b'>y</a><p>WARC/1.0\r\nz"), (2, None, None), (2, None, None)],
                                  "page_id long, url string, html string")
    made = warc.responses(pages)
    out = warc.derive(made.withColumn("extra", F.lit(7)).withColumn("content", F.lit("clash")))
    rows = {(r["page_id"], r["warc_type"]): r for r in out.collect()}
    assert out.count() == 6 and "extra" in out.columns
    source = dict(warc.parse(bytes(made.filter("page_id = 1").first()["record"]))[0])
    conversion, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert conversion["refers_to"] == meta["refers_to"] == source["WARC-Record-ID"]
    assert conversion["content"] == "x y\nWARC/1.0 z" and conversion["source_payload_digest"] == source["WARC-Payload-Digest"]
    body = json.loads(meta["content"])
    assert body["links"] == ["/l?a&b"] and body["title"] == "T" and body["payload_digest_agrees"] and ["Content-Type", "text/html; charset=utf-8"] in body["http"]
    headers, block, whole = warc.parse(bytes(conversion["record"]))
    assert whole and block.decode() == conversion["content"] and dict(headers)["WARC-Block-Digest"] == warc.digest(block)
    # Files: what was written is read back, also a payload with a version line.
    warc.write_warc(made, f"{tmp_dir}/w")
    back = warc.read_warc(spark, f"{tmp_dir}/w")
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted(bytes(r["record"]) for r in made.collect())
    bad = spark.createDataFrame([(None,), (b"junk",), (bytes(made.first()["record"])[:-30],), (warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "x")], b""),)], "record binary")
    assert warc.derive(bad).count() == 0 and warc.unreadable(bad).count() == 3


def _plain_records(data):
    """A sequential parser: records of a WARC file, each as far as it goes."""
    starts = [m.start() for m in re.finditer(rb"WARC/1\.\d+\r\n", data)]
    heads = []
    for s in starts:
        head, found, _ = data[s:].partition(b"\r\n\r\n")
        length = re.search(rb"(?i)\ncontent-length[ \t]*:[ \t]*(\d+)", head)
        # A header's fields stand before any other version string.
        if found and length and re.search(rb"(?i)\nwarc-type[ \t]*:", head) and b"WARC/1." not in head[1:]:
            heads.append((s, s + len(head) + 4 + int(length[1]) + 4))
    out, at = [], 0
    places = {s for s, _ in heads}
    for k, (s, end) in enumerate(heads):
        if s < at:
            continue
        sound = end in places or len(data) <= end <= len(data) + 4
        after = end if sound else next((t for t, _ in heads[k + 1:]), len(data))
        out.append(data[s:after])
        at = after
    return out


@pytest.mark.parametrize("split", ["1g", "997", "4k"])
def test_warc_files_at_any_split(spark, tmp_dir, split):
    """Version strings in payloads, WARC/1.1, short records, records within records: the same records at 1 and at many splits."""
    rnd = random.Random(5)
    good = []
    for k in range(120):
        body = b"<p>text %d</p>" % k + b"x" * rnd.randrange(600)
        if k % 2:
            body += b"\r\nWARC/1.0\r\n" + b"y" * rnd.randrange(90) + b"\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse"
        if k % 10 == 4:
            body += b"\r\n" + warc.response("inner", "http://inner/", b"inner page") + b"tail"
        one = warc.response(f"r{k}", f"http://h/{k}", body)
        good.append(one.replace(b"WARC/1.0\r\n", b"WARC/1.1\r\n", 1) if k % 3 == 0 else one)
    short = good[7][:-60]
    parts = [*good[:40], short, *good[40:90], short, *good[90:], short]
    os.makedirs(f"{tmp_dir}/plain")
    with open(f"{tmp_dir}/plain/a.warc", "wb") as out:
        out.write(b"".join(parts))
    with open(f"{tmp_dir}/plain/b.warc", "wb") as out:
        out.write(b"junk before\r\n" + b"".join(good[:9]))
    want = _plain_records(b"".join(parts)) + _plain_records(b"".join(good[:9])) + [b"junk before\r\n"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = warc.read_warc(spark, f"{tmp_dir}/plain").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted(bytes(r["record"]) for r in records)
    assert got == sorted(want)
    assert sorted(got) == sorted([*good, short, short, short, *good[:9], b"junk before\r\n"])
    frame = spark.createDataFrame([(r,) for r in got], "record binary")
    assert warc.derive(frame).count() == 2 * (len(good) + 9) and warc.unreadable(frame).count() == 4


def test_warc_written_is_read_back_in_derivatives(spark, tmp_dir):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>page {k} WARC/1.0\r\n WARC/1.</p>") for k in range(30)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    warc.write_warc(made, f"{tmp_dir}/d")
    back = warc.read_warc(spark, f"{tmp_dir}/d")
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(bytes(r["record"]) for r in made.collect())
    assert warc.read_warc(spark, f"{tmp_dir}/d").filter("length(record) = 0").count() == 0


def test_language_stage_keeps_what_it_cannot_judge(spark):
    """Without labels all lettered rows stay; with them a wanted language decides, and a null language is filled in."""
    english = [(k, f"the house and the river of number {k} is under the green tree", None, "s", 1) for k in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [*english, (50, None, "en", "s", 0), (51, "123 -- 4", "en", "s", 1), (52, "", None, "s", 0), (None, "letters", None, None, None)]
    unlabelled = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], schema)
    kept = corpus_pipeline.identify_language(spark, unlabelled, "")
    assert kept.columns == unlabelled.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, range(20)), "None"])
    assert corpus_pipeline.identify_language(spark, unlabelled.limit(0), "").count() == 0
    german = [(100 + k, f"das haus und der fluss nummer {k} ist unter dem grünen baum", "de", "s", 1) for k in range(40)]
    named = [(200 + k, f"the house and the river of number {k} is under the green tree", "en", "s", 1) for k in range(40)]
    both = spark.createDataFrame([*rows, *german, *named], schema)
    got = {r["doc_id"]: r["lang"] for r in language.in_learned_language(both).collect() if r["doc_id"] is not None}
    assert set(got) == {*range(20), *range(100, 140), *range(200, 240)} and all(got[k] == "en" for k in range(20))
    assert {r["doc_id"] for r in language.in_learned_language(both, ["de"]).collect()} - {None} == set(range(100, 140))


def test_pipeline(spark, tmp_dir):
    rows = [r[:5] for r in some_docs()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    got = corpus_pipeline.run(spark, tmp_dir).collect()
    sets, links = brute_jaccard([r for r in rows if words(r[1])])
    seen, groups = set(), 0
    for k in sets:
        if k not in seen:
            groups += 1
            todo = [k]
            while todo:
                if (m := todo.pop()) not in seen:
                    seen.add(m)
                    todo += links[m]
    assert len(got) == groups - 1  # the benchmark's own text goes
    assert all(r["n_tokens"] > 0 for r in got)
