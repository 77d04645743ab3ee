"""The ten operators against brute force, round trips and the cases every operator must define."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import html, licenses, line_dedup, ngram_join, packing, quality, storage, suffix_dedup, toxicity, urls
from eventide.llm.decontaminate import decontaminate, digest_items, item_digest, overlaps
from eventide.llm.suffix_array import common_prefixes, suffix_array

WORDS = "the of and a er shth on ünd in reou".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs(spark, texts, schema=DOCS):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def _texts(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(12, 60))) for _ in range(8)]
    out = [None, "", " \n ", "one", "two words", base[0], base[0]]
    while len(out) < n:
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append("\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]))
    return out


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_components(spark, k, percent):
    texts = _texts(1)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = _components(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(_docs(spark, texts), k=k, percent=percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_prefixes_hold_similar_pairs():
    """Any similar pair shares as many prefix shingles as the less demanding side requires, under the common order."""
    rng = np.random.default_rng(5)
    table = rng.integers(1, 2000, 1 << ngram_join.FREQUENCY_BITS)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        x = np.unique(np.concatenate([common, rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        y = np.unique(common[: max(1, n - n // 12)])
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        token, doc, _, matches = ngram_join.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), table, 85)
        assert len(np.intersect1d(token[doc == 0], token[doc == 1])) >= matches.min()


def _shingles(line, k=7):
    """Every run of k characters; a shorter line is its only one."""
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def test_line_classes(spark):
    texts = _texts(2)
    occurrences = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                occurrences[line].append((i, p))
    lines = list(occurrences)
    sets = [_shingles(x) for x in lines]
    links = [(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots = _components(len(lines), links)
    first = {}
    for r, line in zip(roots, lines, strict=True):
        first[r] = min(first.get(r, (10**9, 0)), *occurrences[line])
    want = {o: first[r] for r, line in zip(roots, lines, strict=True) for o in occurrences[line]}
    rows = line_dedup.line_classes(_docs(spark, texts)).collect()
    got = {(r.id, r.pos): (r.class_id, r.class_pos) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(_docs(spark, texts)).collect()}
    assert kept[0] is None and kept[1] == "" and kept[5] == texts[5] and 6 not in kept


def test_line_shingles_at_every_offset(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 16))) for _ in range(300)]
    lines = ["https://example.org/" + "a" * 40, "https://example.org/" + "b" * 40, "日本語の文章" * 9 + "甲" * 20, "日本語の文章" * 2 + "乙" * 60, "\U0001f600 short", "short"]
    for _ in range(25):
        line = " ".join(rng.choice(words) for _ in range(30))
        # Copies that lack a blank, end in one word more or differ in one long word.
        lines += [line, line.replace(" ", "", 1).replace(" ", "", 1), line + " " + rng.choice(words), line.replace(line.split(" ")[9], "x" * 14), line.replace(" ", "")]
    lines = list(dict.fromkeys(lines))
    sets = [_shingles(x) for x in lines]
    roots = _components(len(lines), [(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r.id: r.class_id for r in line_dedup.line_classes(_docs(spark, lines)).collect()}
    assert all(roots[c] == roots[i] for i, c in got.items())  # nothing merges that the definition keeps apart
    assert sum(got[i] != roots[i] for i in range(len(lines))) <= 0.02 * len(lines)
    cases = ["a\U0001f600bc défghijklmnop", "abc", "ééé", "1234567", "aaaaaaaaaaaa"]
    n = spark.createDataFrame([(x,) for x in cases], "line string").select("line", F.size(line_dedup.shingles(F.col("line"))).alias("n")).collect()
    assert {r.line: r.n for r in n} == {x: len(_shingles(x)) for x in cases}


def test_lines_that_only_begin_alike_stay(spark):
    pairs = [
        ("https://example.com/articles/2019/abc", "https://example.com/about/contact-us-now"),
        ("name_of_the_row_1\t2019-01-01\tred\t17.5\tyes", "name_of_the_row_1\t2024-11-30\tblue\t3\tno, later"),
        ("我们今天在北京开会讨论新的计划，大家都同意了。", "我们今天在北京开会之后就去吃饭了，然后回家睡觉。"),
        ("a" * 30 + " " + "b" * 30, "a" * 30 + " " + "c" * 30),
    ]
    texts = [t for pair in pairs for t in pair]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(_docs(spark, texts)).collect()} == dict(enumerate(texts))


def test_lines_with_a_typo_or_other_blanks_are_one(spark):
    words = "several ordinary words of middling length make up this particular line about nothing much".split()
    line = " ".join(words)
    texts = [line, line.replace("particular", "particulxr"), line.replace("middling length", "middlinglength"), line + "!", "多" + "我们今天在北京开会讨论新的计划，大家都同意了，" * 2, "我们今天在北京开会讨论新的计划，大家都同意了，" * 2 + "好", None, "\n\n", ""]
    got = {r.id: r.class_id for r in line_dedup.line_classes(_docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    assert set({r.doc_id: r.text for r in line_dedup.dedup_lines(_docs(spark, texts)).collect()}) == {0, 4, 6, 7, 8}


def test_line_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.80 to 0.83, one by one, so that no third line ties them together."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    lines = []
    while len(lines) < 600:
        a = text(rng.randrange(60, 400))
        b = a
        for _ in range(60):
            x, y = _shingles(a), _shingles(b)
            if len(x & y) / len(x | y) < 0.83:
                break
            at = rng.randrange(len(b))
            b = b[:at] + rng.choice("0123456789") + b[at + 1 :]
        if a != b and 100 * len(x & y) >= 80 * len(x | y):
            lines += [a, b]
    got = {r.id: r.class_id for r in line_dedup.line_classes(_docs(spark, lines)).collect()}
    found = sum(got[i + 1] == i for i in range(0, len(lines), 2))
    assert found >= 0.98 * len(lines) / 2 and all(c in (i, i - 1) for i, c in got.items())


def test_line_groups_of_many_kinds(spark):
    """Copies, a large group of near copies, a very common line, and lines with much in common that are not similar."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    base, start = [word() for _ in range(40)], " ".join(word() for _ in range(12))
    lines = [" ".join(base)] * 30 + ["the very same line"] * 60
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = word()
        lines.append(" ".join(w))
    lines += [start + " " + " ".join(word() for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    rng.shuffle(lines)
    kinds = list(dict.fromkeys(lines))
    sets = [_shingles(x) for x in kinds]
    roots = _components(len(kinds), [(i, j) for j in range(len(kinds)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    first = {}
    for i, line in enumerate(lines):
        first.setdefault(roots[kinds.index(line)], i)
    got = {r.id: r.class_id for r in line_dedup.line_classes(_docs(spark, lines)).collect()}
    assert got == {i: first[roots[kinds.index(line)]] for i, line in enumerate(lines)}


def test_texts_of_lines_alone_go_before_pairs_are_sought(spark, monkeypatch):
    alone = [" ".join(f"{zlib.crc32(f'{i} {k}'.encode()):x}" for k in range(8)) for i in range(40)]
    docs = _docs(spark, [*alone, alone[0] + " again", alone[0]])
    folder, held = storage.shared_folder(spark).removeprefix("file:"), []
    verified, others = line_dedup._verified, set(os.listdir(folder))

    def seen(pairs, texts, *rest):
        for name in set(os.listdir(folder)) - others:
            if "line" in (table := spark.read.parquet(f"{folder}/{name}")).columns:
                held.append(table.count())
        return verified(pairs, texts, *rest)

    monkeypatch.setattr(line_dedup, "_verified", seen)
    kept = {r.id: r.kept for r in line_dedup.line_classes(docs).collect()}
    assert held and max(held) < 10
    assert kept == {i: i < 40 for i in range(42)}


def test_line_signatures_hold_the_least_of_each_class(spark):
    """Few of a long line's hashes are looked at, but the cells are those of all of them; no string is made for each shingle."""
    rng = random.Random(7)
    lines = ["", "a", "sixsix", "seven77", "漢字かな交じり文です", "\U0001f600é" * 9, "abcdefgh" * 400]
    lines += ["".join(rng.choice("abcdefghij é漢\U0001f600") for _ in range(rng.choice([20, 85, 90, 300, 2000]))) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(lines)), "node bigint, line string")
    got = line_dedup.signed(table)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    sets = {r.node: r.h for r in table.select("node", line_dedup.shingles(F.col("line")).alias("h")).collect()}
    assert {k: len(h) for k, h in sets.items()} == {k: len(_shingles(x)) for k, x in enumerate(lines)}
    for r in got.collect():
        classes = [sorted(x for x in sets[r.node] if x & 7 == c)[:3] for c in (4, 5, 6, 7, 0, 1, 2, 3)]
        moved = [[((x + (1 << 63)) >> 3) + ((c - 8 if c > 3 else c) << 61) for c in [xs[0] & 7] for x in xs] for xs in classes if xs]
        assert sorted(r.signature) == sorted(x for xs in moved for x in xs) and len(r.bands) == len(moved), lines[r.node]


def test_rare_shingles_meet_each_pair_once(spark):
    """Lines that share many rare shingles meet at the first of them, and none of the similar pairs is lost."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700))
    lines = []
    for _ in range(30):
        at = rng.randrange(700 - 90)
        lines.append(base[:at] + "".join(rng.choice("0123456789") for _ in range(rng.randrange(20, 90))) + base[at + 90 :])
    sets = [_shingles(x) for x in lines]
    similar = {(i, j) for i in range(30) for j in range(30) if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    entries = line_dedup._rare_first(nodes, nodes.select("node", F.col("node").alias("component")), 7, 80)
    met = line_dedup.pairs_across(entries, 80, "sketch", line_dedup.sketches_close(80, line_dedup.SKETCH), "earlier").collect()
    pairs = {tuple(sorted((r.a, r.b))) for r in met}
    assert similar and similar <= pairs and len(met) < 2 * len(pairs)


def test_long_lists_are_compared_without_rows_per_shingle(spark, monkeypatch):
    """Lists of some dozens of lines that are not all similar: no shingle of theirs is shuffled, and no class is lost; very long lists still go by rare shingles."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700))
    lines = []
    for k in range(60):
        at, n = rng.randrange(700 - 150), rng.choice([30, 60, 150])
        lines.append(f"{k:02d}" + base[:at] + "".join(rng.choice("0123456789") for _ in range(n)) + base[at + n :])
    sets = [_shingles(x) for x in lines]
    roots = _components(60, [(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert 1 < len(set(roots)) < 50
    called, rare, direct = [], line_dedup._rare_first, line_dedup._sketch_pairs
    monkeypatch.setattr(line_dedup, "_rare_first", lambda *a: called.append("rare") or rare(*a))
    monkeypatch.setattr(line_dedup, "_sketch_pairs", lambda *a: called.append("direct") or direct(*a))
    for long, way in ((4096, "direct"), (16, "rare")):
        called.clear()
        monkeypatch.setattr(line_dedup, "LONG_LIST", long, raising=False)
        got = {r.id: r.class_id for r in line_dedup.line_classes(_docs(spark, lines)).collect()}
        assert way in called and (way == "rare" or "rare" not in called)  # short lists of the further bands go directly in any case
        assert [got[i] for i in range(60)] == roots


def test_pairs_of_long_lists_come_once(spark):
    """Lines that share several lists meet at one of them, and no similar pair that shares a list is lost."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500))
    lines = [base[:at] + "".join(rng.choice("0123456789") for _ in range(n)) + base[at + n :] for at, n in [(rng.randrange(400), rng.choice([10, 40, 90])) for _ in range(40)]]
    sets = [_shingles(x) for x in lines]
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    sketched = line_dedup._sketched(line_dedup._entries(nodes, nodes.select("node", F.col("node").alias("component")), 7))
    lists = spark.createDataFrame([(t, k) for k in range(40) for t in (k % 2, 2 + k % 3, 9)], "token long, node long")
    met = [tuple(r) for r in line_dedup._sketch_pairs(lists, sketched, 80).collect()]
    similar = {(i, j) for j in range(40) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert similar and similar <= set(met) and len(met) == len(set(met)) < 40 * 39 / 2


def test_distinct_lines_and_shared_bands_in_parts(spark):
    """The parts together are every distinct line and every shared band; a cell takes four bytes on disk."""
    lines = spark.createDataFrame([(f"line {i % 70} with some words {i % 70 * 7919}",) for i in range(100)], "line string")
    texts = line_dedup._distinct(lines)
    got = texts.collect()
    assert len({r.node for r in got}) == len(got) == 70 == len({r.line for r in got})
    assert dict(line_dedup._signs(texts, 7).dtypes)["signature"] == "array<int>"
    entries = [(i * i % 40 - 20, i) for i in range(60)]
    held = collections.defaultdict(list)
    for token, node in entries:
        held[token].append(node)
    shared = line_dedup._shared(spark.createDataFrame(entries, "token bigint, node bigint")).collect()
    assert sorted(map(tuple, shared)) == sorted((k, min(v)) for k, v in held.items() if len(set(v)) > 1)


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (4, {}), (0, {"piece": 64, "most_held": 50}), (4, {"piece": 100, "most_held": 9})])
def test_remove_repeats(spark, seed, options):
    """The last two cut the longer texts into pieces and send records a few at a time."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    texts = [None, "", "ab" * 60, "ab" * 40, base[0], base[0]]
    for _ in range(50):
        b, c = rng.choice(base), rng.choice(base)
        texts.append(b[rng.randrange(len(b)) :] + c[: rng.randrange(len(c))] + str(rng.randrange(9)))
    data, first = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(data):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = {}
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(_docs(spark, texts).repartition(3), **options).collect()}
    assert got == want


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(30))]
        sa = suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        for k, h in enumerate(common_prefixes(s, sa)):
            a, b = s[sa[k] :], s[sa[k - 1] :] if k else []
            assert h == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*_texts(3), "x" * 9000, "a<|endoftext|>b", "  a \n\n b\t"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(_docs(spark, texts), with_ids=True).collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(docs[r.doc_id]) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs[r.doc_id] += r.ids
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(docs) == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_leaves_no_ids_and_no_tokenizer(spark):
    e = packing.Encoder(packing.default_tokenizer())
    assert len(e.encode(["plain words", ""])) == 2 and "tokenizer" not in vars(e)
    folder = storage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    pieces = packing.pack(_docs(spark, _texts(3)))
    assert {f"{folder}/{x}" for x in set(os.listdir(folder)) - before} == {pieces._staged_at.removeprefix("file:")}
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_hilbert_is_a_curve():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_overlaps(spark):
    rng = random.Random(7)
    items = [(0, " ".join(f"w{i}" for i in range(20))), (1, "short item here"), (2, "alone"), (3, None), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 x")]
    texts = [None, "", "!!", "W0 w1, w2 W3 w4 w5 w6 w7 w8 w9 w10 w11 w12 tail", "a short Item here b", "alone alone", "w1 w2 w3"]
    texts += [" ".join(rng.choice([*(f"w{i}" for i in range(20)), "alone", "short", "item"]) for _ in range(40)) + " w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17" for _ in range(10)]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = find(t), set(), set()
        for name, text in items:
            v = find(text)
            n = min(13, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[a : a + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(name))
        want[i] = (len(w), len(hit), len(found), item_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in digest_items(overlaps(_docs(spark, texts), bench)).collect()}
    assert got == want
    left = decontaminate(_docs(spark, [*texts, "pad " * 400 + "short item here end"]), bench)
    assert left.columns == _docs(spark, [""]).columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert set(kept) == {i for i, v in want.items() if not v[4]} | {len(texts)}
    assert "short item here" not in kept[len(texts)] and kept[len(texts)].endswith("pad end")


def test_quality(spark):
    texts = [None, "", "a b c d e f g h i j", "a b c d e " * 4, "x\ny\nx\n\n\n", "the of and " * 5 + "#$%"]
    got = {r.doc_id: r for r in quality.quality(_docs(spark, texts)).collect()}
    assert [got[i].n_words for i in range(6)] == [0, 0, 10, 20, 3, 16]
    assert [got[i].base_failed for i in range(4)] == [True, True, False, True]
    assert got[3].n_repeat_words == 20 and got[4].n_dup_lines == 1 and got[5].n_symbols == 3 and got[2].kept


def test_toxicity(spark):
    rng = random.Random(0)
    texts, rows = [None, ""], []
    for i in range(2, 500):
        bad = i % 5 == 0
        texts.append(" ".join([rng.choice(WORDS) for _ in range(20)] + ["idiot", "people"] * bad + ["people"] * (not bad and i % 3 == 0)))
        rows.append((i, int(bad)))
    labels = spark.createDataFrame([*rows, (1, None), (9999, 1)], "doc_id bigint, toxic int")
    docs = _docs(spark, texts)
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    truth = dict(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def test_fm_learns_pairs():
    """Either term alone is harmless, both together are not: weights alone cannot tell."""
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.array([1] * a + [2] * b + [int(rng.integers(100, 200))], "<i4"))
        labels.append(float(a and b))
    m = toxicity.FactorizationMachine.fit(sets, np.array(labels))
    s = m.scores(np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2]), 3)
    assert s[2] > 0.5 > max(s[0], s[1])


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='x'>Site {i} &amp; co</div><div><p>Body  {i}<br>more &lt;b&gt;<p>Next {i}<ul><li>a{i}<li>b{i}</ul></div><footer>f</footer></body></html>"
    rows = [(i, f"http://h.org/{i}", page.replace("Site {i}", "Site").replace("{i}", str(i))) for i in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "http://h.org/a", "<article><h1>T</h1><div class='comments'>no</div><p>yes & no</article><p>out")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (100, 0):
        got = {r.page_id: r for r in html.extract_text(pages, most_sent=most).collect()}
        assert got[3].text == "Body 3 more <b>\nNext 3\na3\nb3" and got[3].n_chars == len(got[3].text)
        assert got[20].text == got[21].text == "" and got[22].text == "T\nyes & no"


def test_html_copies_are_no_template(spark):
    shared = "<div class='site'>Site line</div>"
    copied = "<html><body>{}<article><h1>T</h1><div class='post-body'><p>The story</p></div></article></body></html>"
    rows = [(i, f"http://c.org/{i}", copied.format("")) for i in range(6)]
    rows += [(10 + i, f"http://p.org/{i}", f"<body>{shared}<div><p>The same story</p></div></body>") for i in range(6)]
    rows += [(20 + i, f"http://p.org/n{i}", f"<body>{shared}<div><p>Story {i}</p></div></body>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (100, 0):
        got = {r.page_id: r.text for r in html.extract_text(pages, most_sent=most).collect()}
        assert {got[i] for i in range(6)} == {"T\nThe story"} and {got[10 + i] for i in range(6)} == {"The same story"}
        assert [got[20 + i] for i in range(6)] == [f"Story {i}" for i in range(6)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header class='entry-header'><h1>T</h1></header><p>x</p></article>", ["T", "x"]),
        ("<article><div class='article-header'><h1>T</h1></div><p>x</p></article>", ["T", "x"]),
        ("<article class='post comments-open category-search'><p>x</p></article>", ["x"]),
        ("<div class='content-with-sidebar'><p>x</p></div><div class='no-sidebar'><p>y</p></div>", ["x", "y"]),
        ("<div class='banner-page'><article><p>x</p></article></div>", ["x"]),
        ("<div class='site-header'>h</div><div class='ad-slot'>a</div><div id='sidebar1'>s</div><div class='a cookie-banner'>c</div><p>x</p>", ["x"]),
        ("<div class='comments'><article><p>c</p></article></div><p>x</p>", ["x"]),
        ("<p title='a hidden gem'>x</p><div data-id='menu'>y</div>", ["x", "y"]),
        ("<div class='has-sidebar'><article><p>x</p></article></div>", ["x"]),
        ("<form><h1>T</h1><div><p>x</p><label>l</label></div></form>", ["T", "x"]),
        ("<form><article><p>x</p></article></form><form>f</form>", ["x"]),
        ("<p class='share-price'>x</p><section id='notice-of-default'><p>y</p></section>", ["x", "y"]),
        ("<form><label>l</label></form><p>x</p>", ["x"]),
        ("<div aria-hidden='true'>n</div><div hidden>n</div><div role=navigation>n</div><p>x</p>", ["x"]),
        ("<article><p>x</p><article class='comment'><p>c</p></article><div class='post-comments'>d</div></article>", ["x"]),
    ],
)
def test_html_marks(page, want):
    assert html.read_page(f"<body>{page}</body>")[0] == want


def test_html_templates_by_brute_force(spark):
    rng = random.Random(11)
    rows, lines = [], {}
    for i in range(120):
        own = [f"own {i}"] if rng.random() < 0.8 else ["a shared story"]
        lines[i] = rng.sample([f"block {j}" for j in range(12)], rng.randrange(0, 4)) + own
        rows.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(f"<div class='k'><span>{x}</span></div>" for x in lines[i]) + "</body>"))
    want = {}
    for host in range(3):
        mine = {i: x for i, x in lines.items() if i % 3 == host}
        total = len({tuple(sorted(x)) for x in mine.values()})
        rests = collections.defaultdict(set)
        for x in mine.values():
            for line in x:
                rests[line].add(tuple(sorted(y for y in x if y != line)))
        gone = {line for line, r in rests.items() if len(r) >= 5 and len(r) >= 0.1 * total}
        want |= {i: "\n".join(y for y in x if y not in gone) for i, x in mine.items()}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert any("block" not in t for t in want.values())
    for most in (1000, 0):
        assert {r.page_id: r.text for r in html.extract_text(pages, most_sent=most).collect()} == want


def test_html_time_is_linear_in_depth():
    import time

    def seconds(n):
        page = "<body>" + "<div class=a>" * n + "x" + "</div>" * n
        start = time.perf_counter()
        assert html.read_page(page)[0] == ["x"]
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(20_000) < 60 * max(seconds(1000), 1e-3)


def test_html_edge_cases(spark):
    assert html.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    rows = [(1, "http://h.org/", "<p>x</p>", "host", 3)] * 2 + [(None, None, "<p>y &amp; z</p>", None, None), (2, "bad", "no markup < at all", "m", 1), (3, "http://h.org/l", "<p>" + "word " * 400_000, "t", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, marks int")
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in html.extract_text(pages).collect())
    assert got == [(0, "y & z", 5), (1, "x", 1), (1, "x", 1), (2, "no markup < at all", 18), (3, "word word word word w"[:20], 1_999_999)]


def test_urls(spark):
    cases = [None, "x", "http://A.Example.org/en/12?q#f", "https://example.org/es/x", "http://b.com/de/", "ftp://b.com/fr/1", "http://org", "http://notorg/", "http://example.org:80/es/"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages).collect()}
    assert got == {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, most_sent=0).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/es/x", "example.org/es/", "block"),
        4: ("b.com", "/de/", "com/de/", "block"), 5: ("b.com", "/fr/1", "com/fr/", "allow"), 6: ("org", "", None, "allow"), 7: ("notorg", "/", None, "allow"), 8: ("example.org:80", "/es/", None, "allow"),
    }


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/code", "some text without"), (3, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/x", "plain"), (5, "z/x", "plain"), (6, "a/q", "words " * 30 + "\nLicensed under CC BY-NC 4.0."), (7, None, None), (8, "a/b/e", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.own_license, r.license) for r in licenses.scan_licenses(docs, docs["path"]).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: ("Apache-2.0", "Apache-2.0"), 4: (None, "Apache-2.0"), 5: (None, None), 6: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 7: (None, None), 8: (None, "MIT")}


def test_license_texts_headers_and_identifiers(spark):
    texts = dict(licenses.full_templates()[:9])
    gnu = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
    cases = [
        ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("MIT License", "MIT"),
        ("License: MIT", "MIT"), ("The MIT License (MIT)", "MIT"), ("Licensed under the MIT license", "MIT"), ("This work is licensed under CC BY 4.0", "CC-BY-4.0"),
        ("/*\n" + gnu + " */\n\nint main() { return code + more * here; }\n", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"),
        ("Copyright (c) 2020 Somebody\n\n" + texts["MIT"], "MIT"), *((text, name) for name, text in texts.items()), ("a story of a license to fish in the lake", None),
    ]
    docs = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t, _) in enumerate(cases)], "doc_id bigint, path string, text string")
    rows = licenses.scan_licenses(docs, docs["path"]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(cases) and [got[i].own_license for i in range(len(cases))] == [name for _, name in cases]
    assert all(got[i].is_file for i in range(10, 20))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_components(docs).count() == line_dedup.line_classes(docs).count() == suffix_dedup.remove_repeats(docs).count() == 0
    assert quality.quality(docs).count() == packing.pack(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == 0
    assert overlaps(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert licenses.scan_licenses(docs.withColumn("path", docs["source"]), docs["source"]).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "x", 9, "n", 1)] * 2 + [(None, "null id text here", "en", "x", 9, "n", 2)], DOCS + ", node string, kept int")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.ngram_components(docs).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert quality.quality(docs).count() == 3 and suffix_dedup.remove_repeats(docs).where("n_removed > 0").count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == 3


def test_clashing_columns_and_repeats_of_the_others(spark):
    """Extra columns under names the operators use themselves, repeated rows and null ids."""
    rows = [(1, "a b c d e f g h i j k l m", "en", "x", 9, "n", 1, "u", 3), (1, "a b c d e f g h i j k l m", "en", "x", 9, "n", 1, "u", 3), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", key string, label int, license string, items int")
    assert packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).count() == 2
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == 3
    bench = spark.createDataFrame([("i", "b c d", 4)] * 2 + [(None, None, None)], "item_id string, text string, items int")
    assert sorted(r.n_hit for r in overlaps(docs, bench).collect()) == [0, 3, 3] and decontaminate(docs, bench).count() == 1
    assert licenses.scan_licenses(docs, docs["source"]).count() == 3
    pages = spark.createDataFrame([(1, "http://a.org/x", "r", 1)] * 2 + [(None, None, None, None)], "page_id bigint, url string, rule string, row int")
    assert [r.verdict for r in urls.judge_urls(pages).collect()] == ["allow"] * 3


def test_pipeline_stages(spark, tmp_path):
    """Every stage on a small corpus of each kind of document, by what must stay and what must go."""
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "in", "to", "is"]) + " " + word() for _ in range(n))
    clean = [prose(60) for _ in range(12)]
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    near = clean[0].split(" ")
    near[50] = "changed"
    halves = lambda t: t[: len(t) // 2] + "\n" + t[len(t) // 2 :]
    texts = [*clean, " ".join(near), clean[1], "too short", None, "again and again " * 20, prose(40) + "\n" + items[0], items[1], halves(clean[2]).replace("\n", "\n \n"), prose(30) + "\nshared line of every page here\n" + prose(30), prose(30) + "\nshared line of every page here\n" + prose(30)]
    docs = _docs(spark, texts)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    left, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        left = function(spark, left, folder)
        assert left.columns == docs.columns
        ids[name] = {r.doc_id: r.text for r in left.collect()}
        left = spark.createDataFrame(left.collect(), docs.schema)
    n = len(clean)
    assert not {n + 2, n + 3, n + 4} & set(ids["quality_rules"]) and set(range(n)) <= set(ids["quality_rules"])
    assert n + 1 not in ids["line_dedup"] and "shared line" in ids["line_dedup"][n + 8] and "shared line" not in ids["line_dedup"][n + 9]
    assert 0 in ids["near_duplicates"] and n not in ids["near_duplicates"]
    assert n + 6 not in ids["decontamination"] and n + 5 not in ids["decontamination"] and set(range(n)) <= set(ids["decontamination"])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(ids["decontamination"])
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in ids["decontamination"])
