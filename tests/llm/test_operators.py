"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and copies."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import bagminhash, cuckoo, fertility, html, licences, mixing, packing, passages, suffixes, weaklabels
from lodestream.llm.common import tokenizer_path


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    texts = [prose(rng.randint(1, 200)) for _ in range(n)]
    for k in range(0, n, 7):
        texts[k] = prose(30) + " " + passage + " " + prose(20)
    for k in range(3, n, 11):
        words = texts[k - 1].split()
        if len(words) > 60:
            words[5] = "changed"
        texts[k] = " ".join(words)
    texts[10:16] = [texts[9]] * 6
    texts += [None, "", " \n\t", "x", prose(3000), "Released under the MIT License.\nmit  license", "ünï cödé ☃ " * 20]
    rows = [(k, t, ["en", "de", None][k % 3], ["s1", "s2", "s2", None][k % 4], k) for k, t in enumerate(texts)]
    return rows + [rows[9], (None, "no id " * 30, "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_words long").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def raw(t):
    return (t or "").encode()


def test_empty_tables(empty):
    assert fertility.with_fertility(empty, ["doc_id"]).count() == 0
    assert cuckoo.exact_groups(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert packing.packed_documents(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0
    assert bagminhash.near_groups(empty).count() == 0
    assert passages.near_passages(empty).count() == 0
    assert weaklabels.classified(empty).count() == 0
    assert fertility.filtered(empty).columns == empty.columns


def plain_fertility(words, text, lang, sentences, pairs):
    """The rules again, with plain loops over the vocabularies' own encoders."""
    ids = [i for w in words for i in sentences.encode(w)]
    chars = sum(map(len, words))
    n_pairs = len(pairs.encode(text, add_special_tokens=False).ids)
    sizes = Counter(ids)
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in sizes.values()) if ids else 0.0
    fallback = sum(sentences.is_byte(i) or sentences.is_unknown(i) for i in ids) / len(ids) if ids else 0.0
    band = fertility.LANGUAGE_BANDS.get(lang) or fertility.SCRIPT_BANDS[fertility.script_of(text)]
    measures = (chars / len(ids) if ids else 0.0, fallback, bits, chars / n_pairs if n_pairs else 0.0)
    low, high = band.chars_per_token
    return measures, low <= measures[0] <= high and fallback <= band.byte_share and bits >= band.token_entropy and measures[3] >= band.chars_per_pair


def test_fertility(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    sentences = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    pairs = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    known = "the house and garden of people with water under trees where children walk every morning before school while birds sing over green fields near rivers that carry boats slowly toward towns full of markets bread fish stones windows".split()
    some = lambda k: " ".join(rng.choice(known) for _ in range(k))
    hard = " ".join("".join(rng.choice("qxzkvwj") for _ in range(5)) for _ in range(80))
    more = [(k, t, lang) for k, (t, lang) in enumerate([
        (some(90), "en"), (some(200) + "\nsame line\nsame line\n\n \nsame line", "en"), (hard, "en"), (some(60) + " #a *b $c %d &e |f <g>", "de"), ("да нет " * 60, None), (some(49), "en"), (some(50), "xx"),
        (" ".join(chr(0x4E00 + rng.randrange(2000)) * 3 for _ in range(70)), "zh"), ("word " * 80, "en"), ("\U0001f600 \u2603 " * 60, None),
    ], 10_000)]
    rows = [r[:3] for r in corpus()] + more
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    out = fertility.with_fertility(table, ["doc_id"]).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    verdicts = set()
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = by_id[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(again))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        measures, fits = plain_fertility(words, text, lang, sentences, pairs)
        assert (r["chars_per_token"], r["byte_share"], r["token_entropy"], r["chars_per_pair"]) == pytest.approx(measures)
        assert r["kept"] == (not r["base_failed"] and fits)
        verdicts.add((r["base_failed"], r["kept"]))
    assert verdicts == {(True, False), (False, True), (False, False)}
    assert not by_id[10_002]["base_failed"] and not by_id[10_002]["kept"]
    kept = fertility.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t, *_ in corpus() if by_id[i]["kept"])


def test_words_kept_are_bounded(monkeypatch):
    tool = fertility.Meter(tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(fertility.Meter, "BYTES", 50_000)
    long = [hashlib.sha512(str(k).encode()).hexdigest().encode() for k in range(2000)]
    for k in range(0, 2000, 100):
        tool.tokens(long[k : k + 100])
    assert tool.held < 200_000 and len(tool.cache) < 500


def test_cuckoo_index():
    index = cuckoo.CuckooIndex(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k in keys:
        index.put(k, 1)
    assert index.resizes and all(k in index for k in keys) and hashlib.sha256(b"x").digest() not in index
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert index.size == 1500 and [k in index for k in keys] == [k % 2 == 1 for k in range(3000)]


def test_exact_groups(docs):
    rows = corpus()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(raw(text), []).append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    wanted = sorted((str(i), str(best[raw(t)]), len(groups[raw(t)]), i == best[raw(t)], hashlib.sha256(raw(t)).hexdigest()) for i, t, *_ in rows)
    got = sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in cuckoo.exact_groups(docs).collect())
    assert got == wanted
    kept = cuckoo.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_index_tables(spark):
    rows = [(k, hashlib.sha256(str(k % 700).encode()).digest()) for k in range(2000)]
    index = cuckoo.groups(spark.createDataFrame(rows, "__id long, __digest binary"))
    dead = [(hashlib.sha256(str(k).encode()).digest(),) for k in [*range(0, 700, 7), 10**6]]
    left = {bytes(r["__digest"]): (r["keep_id"], r["group_size"]) for r in cuckoo.without(index, spark.createDataFrame(dead + dead[:3], "__digest binary")).collect()}
    assert left == {hashlib.sha256(str(k).encode()).digest(): (max(range(k, 2000, 700)), len(range(k, 2000, 700))) for k in range(700) if k % 7}


CLASHES = ["keep_id", "__digest", "__id", "__row", "__first", "__size", "__turns", "__source", "__h", "__draws", "__q_kept", "kept", "__gone", "class_id", "__node", "shard", "place", "a`b", "x.y", "__text", "__order"]


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(k, t, lang, source) for k, t, lang, source, _ in corpus()]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = base.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(CLASHES)])
    for operator in (fertility.filtered, cuckoo.deduplicated, bagminhash.deduplicated, mixing.drawn):
        plain, out = operator(base), operator(table)
        assert out.columns == table.columns, operator
        got = sorted(map(str, (tuple(r) for r in out.collect())))
        assert got == sorted(str((*r, *(f"v{k}" for k in range(len(CLASHES))))) for r in plain.collect()), operator
    for operator in (mixing.mixed, cuckoo.exact_groups, bagminhash.near_groups, passages.near_passages, licences.scan, suffixes.without_repeats):
        assert sorted(map(str, operator(base).collect())) == sorted(map(str, operator(table).collect())), operator
    assert packing.packed_documents(table).count() == packing.packed_documents(base).count()


def test_shards_of_the_tree(docs):
    out = [(r["__row"]["doc_id"], r["shard"], r["place"]) for part in mixing.shards(docs, shard_blocks=2).rdd.glom().collect() for r in part]
    by_shard = {}
    for doc_id, shard, place in out:
        by_shard.setdefault(shard, []).append(place)
    assert len(by_shard) > 2 and all(p == sorted(p) for p in by_shard.values())
    sizes = mixing.checkpointed(mixing._slim(docs, "doc_id", "text", "source"))
    made, _, _ = mixing.plan(sizes, shard_blocks=2)
    drawn = Counter((made.sources.index(next(s for s in made.sources if s[0] == b[0])), b[3]) for b in made.blocks)
    # A leaf's quotas are what its shard draws, and no block of a pass goes to two shards.
    assert drawn == {(i, k): n for k, row in enumerate(made.quotas.tolist()) for i, n in enumerate(row) if n}
    assert len({b[:3] for b in made.blocks}) == len(made.blocks)
    taken = Counter(x for x, *_ in out)
    assert {r["doc_id"]: len(r["shards"]) for r in mixing.mixed(docs, shard_blocks=2).collect() if r["size"] and r["shards"]}.items() <= taken.items()


def test_mixing(docs):
    out = mixing.mixed(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    by_target = {}
    for r in out:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r)
    assert abs(sum(t for _, t in by_target) - 1.5 * total) < 1e-6 * total
    for (_, target), rows in by_target.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    drawn = mixing.drawn(docs)
    assert drawn.columns == docs.columns


def test_targets_and_tree():
    sizes, weights = np.array([10, 100, 0, 50]), np.array([3.0, 1, 2, 3])
    got = mixing.targets(sizes, weights)
    assert abs(got.sum() - 240) < 1e-9 and (got <= 2 * sizes + 1e-9).all() and got[2] == 0
    quotas = np.array([7, 0, 100, 13])
    leaves = mixing.split(quotas, 5)
    assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all() and np.ptp(leaves.sum(axis=1)) <= 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        e = rng.integers(0, 2**63, 100).astype(np.uint64)
        a, b = rng.integers(1, 9, 100), rng.integers(1, 9, 100)
        s = bagminhash.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 100), 2, 256)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02


def test_near_groups(docs):
    rows = corpus()
    bags = {}
    for _, text, *_ in rows:
        w = raw(text).split()
        grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        bags[raw(text)] = Counter(grams)
    names = list(bags)
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(names):
        for b in names[:i]:
            if bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                root[find(a)] = find(b)
    wanted = {}
    for i, t, *_ in rows:
        wanted.setdefault(("alone", i) if not bags[raw(t)] else find(raw(t)), set()).add(i)
    got = {}
    for r in bagminhash.near_groups(docs).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert sorted(map(sorted, (map(str, s) for s in got.values()))) == sorted(map(sorted, (map(str, s) for s in wanted.values())))
    assert bagminhash.deduplicated(docs).columns == docs.columns


def test_near_groups_of_one_template(spark, monkeypatch):
    # Buckets are dealt out in many cells.
    monkeypatch.setattr(bagminhash, "CELL_NODES", 25)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(300)]
    copies = []
    for _ in range(300):
        words = template[:]
        for k in rng.sample(range(0, 300, 2), 5):
            words[k] = word()
        copies.append(words)
    grams = [{tuple(w[k : k + 5]) for k in range(296)} for w in copies]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            common = len(a & grams[j])
            if common >= 0.8 * (len(a) + len(grams[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(copies)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_groups(docs).collect()}
    assert 30 < len({find(k) for k in range(300)}) < 290
    assert got == {k: find(k) for k in range(300)}


def test_common_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(n)]
        got = bagminhash.common_counts(np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets))), n)
        for i in range(n):
            for j in range(i):
                assert got[i, j] == got[j, i] == len(np.intersect1d(sets[i], sets[j]))
        rows = np.flatnonzero(rng.random(n) < 0.4)
        part = bagminhash.common_counts(np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets))), n, rows)
        assert all(part[k, j] == got[i, j] for k, i in enumerate(rows) for j in range(n) if i != j)


def test_licences(docs):
    by_id = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    lower = str.maketrans(licences.UPPER, licences.LOWER)
    for doc_id, text, *_ in corpus():
        words = re.findall(licences.WORD, (text or "").translate(lower))
        places = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = by_id[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1


def plain_labels(texts):
    """Labels and score of every text, by plain loops over words, templates and offsets."""
    postings, entries = licences.index()
    vocabulary = {p[0] for p in postings}
    words = {t: licences.words_of(t) for t in texts if any(g in t.lower() for g in licences.GATE)}
    df = Counter(w for ws in words.values() for w in set(ws) & vocabulary)
    out = {}
    for t in texts:
        ws = words.get(t, [])
        top = set(sorted(set(ws) & vocabulary, key=lambda w: (df[w], w))[: licences.TOP_WORDS])
        labels, score = set(), 0.0
        for k, (label, _, keys) in enumerate(licences.TEMPLATES):
            whole = next(e[3] for e in entries if e[:2] == ("template", k))
            mine = [(w, at, weight) for w, kind, entry, at, weight in postings if (kind, entry) == ("template", k) and w in top]
            offsets = [(at, pos - at, weight) for pos, w in enumerate(ws) for x, at, weight in mine if x == w]
            best = 0.0
            for band in {o // 16 + d for _, o, _ in offsets for d in (0, -1)}:
                best = max(best, sum({at: weight for at, o, weight in offsets if o // 16 in (band, band + 1)}.values()))
            phrases = all(any(ws[i : i + len(p)] == p for i in range(len(ws))) for p in map(licences.words_of, keys))
            if best >= licences.MIN_SCORE * whole - 1e-9 and phrases:
                labels.add(label)
                score = max(score, best / whole)
        based = {label for phrase, label in licences.BASE.items() if any(ws[i : i + len(phrase.split())] == phrase.split() for i in range(len(ws)))}
        out[t] = (",".join(sorted(labels | based)), 1.0 if based else min(1.0, score))
    return out


def test_licence_templates(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta with the software and of this code to use".split()) for _ in range(n))
    bodies = [text for _, text, _ in licences.TEMPLATES]
    texts = [f"{filler(20)}\n{text}.\n{filler(9)}" for text in bodies]
    n = len(texts)
    for text in bodies[:13]:
        words = text.split()
        shuffled = words[:]
        rng.shuffle(shuffled)
        texts.append("licensed " + " ".join(shuffled))  # all words, no place
        texts.append("licensed " + " ".join(w if rng.random() < 0.93 else "changed" for w in words))
        texts.append("licensed " + " ".join(words[: len(words) // 3]))
    texts += [f"{bodies[0]} {bodies[1]} {bodies[5]}", "a licence to permission creative works", filler(300), "permission is hereby granted free of charge", bodies[0].upper()]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["labels"], pytest.approx(r["score"])) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = plain_labels(texts)
    assert got == {k: wanted[t] for k, t in rows}
    assert all(licences.TEMPLATES[k][0] in got[k][0].split(",") for k in range(n))
    assert all(licences.TEMPLATES[k][0] not in got[n + 3 * k][0].split(",") for k in range(13) if licences.TEMPLATES[k][0] != "gpl")
    assert {"mit", "apache", "bsd"} <= set(got[n + 39][0].split(",")) and not got[n + 40][0] and not got[n + 42][0]


def test_suffixes(docs):
    rows = corpus()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, wanted = set(), []
    for k in order:
        b = raw(rows[k][1])
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            gone[s : s + 100] |= w in seen
            seen.add(w)
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        wanted.append((str(rows[k][0]), len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in suffixes.without_repeats(docs).collect()]
    assert sorted(got) == sorted(wanted)


def test_suffixes_with_hot_anchors(docs):
    plain = sorted(map(str, suffixes.without_repeats(docs).collect()))
    # Every anchor with more than two places goes the way of hot ones.
    assert sorted(map(str, suffixes.without_repeats(docs, hot=2).collect())) == plain


def test_sort_of_suffixes():
    rng = np.random.default_rng(0)
    buffer = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 300)
    group = np.sort(rng.integers(0, 5, 300))
    order = suffixes.sort_suffixes(suffixes.Prefix(buffer), starts, group, 50)
    wanted = sorted(range(300), key=lambda k: (group[k], bytes(buffer[starts[k] : starts[k] + 50]), k))
    assert order.tolist() == wanted


def test_passages(docs):
    rows = corpus()
    seen = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    classes = {r["doc_id"]: r["class_id"] for r in passages.near_passages(docs).collect()}
    for ids in seen.values():
        assert len({classes[i] for i in ids}) == 1


def test_passages_of_later_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda k: [word() for _ in range(k)]

    def leads(words, f):
        """The tokens that lead a window, with its end."""
        tokens = passages.shingles(" ".join(words).encode())
        _, at, last = passages.compact_windows(passages.token_hashes(tokens, f))
        return {int(tokens[k]): (int(k), int(b)) for k, b in zip(at, last)}

    def elsewhere(passage, *texts):
        """A text in which the passage's tokens that lead windows of all ``texts`` lead windows too, in other surroundings."""
        tokens = passages.shingles(" ".join(passage).encode()).tolist()
        first = next(c for c, token in enumerate(tokens) if all(token in leads(t, 0) for t in texts))
        out = []
        for f in range(8):
            for c, token in enumerate(tokens):
                while all(token in leads(t, f) for t in texts):
                    # A token of a first function beside it lets its window be looked at.
                    words = prose(60) + passage[first : first + 5] + prose(3) + passage[c : c + 5] + prose(60)
                    if token in leads(words, f) and leads(words, 0).get(tokens[first], (60, 0)) >= (60, 68):
                        out += words
                        break
        return out

    p, q = prose(50), prose(50)
    v, w, x = prose(20) + p + prose(20), prose(30) + p + prose(30), prose(20) + q + prose(20)
    rows = [elsewhere(p, v, w), v, w, elsewhere(q, x) + q, x]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.near_passages(docs).collect()}
    assert [got[k]["class_id"] for k in range(5)] == [0, 1, 1, 3, 3]
    spans = {k: [tuple(map(int, x.split("-"))) for x in got[k]["spans"].split(",") if x] for k in got}
    assert any(a <= 30 and b >= 80 for a, b in spans[2]) and any(a <= 20 and b >= 70 for a, b in spans[4])


def test_passages_at_the_threshold(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(50)]
        rows.append((2 * k, " ".join(words)))
        words[25] = "changed"  # 41 of 51 shingles stay
        rows.append((2 * k + 1, " ".join(words)))
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("class_size = 2").count()
    # A pair that shares a least token under one of eight functions is found.
    assert got >= 2 * 399


def test_passages_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    prose = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    shared = [prose(56) for _ in range(6)]
    rows = []
    for k in range(70):
        words = prose(rng.randint(5, 40))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(shared)[:]
            for _ in range(rng.randint(0, 3)):  # from equal to hardly alike
                j = rng.randrange(len(piece))
                piece[j : j + 1] = rng.choice([[], prose(1), prose(2)])
            words += piece[rng.randint(0, 5) :] + prose(rng.randint(1, 30))
        rows.append(words)
    rows += [rows[3], ["x"] * 120, ["x"] * 52 + prose(20), ["y", "z"] * 60, prose(30) + ["y", "z"] * 40, shared[0][:12] + prose(60), shared[0][:12] + prose(50)]
    tokens = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def resembles(a, b):
        if sum((Counter(a) & Counter(b)).values()) < 41:
            return False
        return any(sum((Counter(a[i : i + 46]) & Counter(b[j : j + 46])).values()) >= 41 for i in range(len(a) - 45) for j in range(len(b) - 45))

    for i in range(len(rows)):
        for j in range(i):
            if resembles(tokens[i], tokens[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["spans"]) for r in passages.near_passages(docs).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: find(k) for k in range(len(rows))}
    assert 5 < len({find(k) for k in range(len(rows))}) < 60
    # Hot tokens are dealt out over salts, and open tokens in many cells.
    monkeypatch.setattr(passages, "HOT_WINDOWS", 3)
    monkeypatch.setattr(passages, "CELL_WINDOWS", 4)
    monkeypatch.setattr(passages, "HOT_SAMPLE", (10**6, 3))
    assert {r["doc_id"]: r["class_id"] for r in passages.near_passages(docs).collect()} == {k: c for k, (c, _) in got.items()}
    for k, (c, spans) in got.items():
        for a, b in (map(int, x.split("-")) for x in spans.split(",") if x):
            assert c != k and 0 <= a and a + 50 <= b <= len(rows[k])


def test_open_tokens_grow_in_proportion(spark, monkeypatch):
    rng = random.Random(15)
    prose = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    line, rows = prose(14), []
    for k in range(150):  # one line in pairs of texts that have nothing else in common with other pairs
        words = prose(45) + line + prose(45)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(prose(10) + words + prose(10)))]
    dealt, cells = [], passages.cells

    def counted(*args):
        made = cells(*args)
        dealt.append(made.count())
        return made

    monkeypatch.setattr(passages, "cells", counted)
    monkeypatch.setattr(passages, "CELL_WINDOWS", 10)
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in range(300)}
    # Each of the line's tokens is open in 150 classes: each window in 15 cells, were they all compared with each other.
    assert sum(dealt) < 150


def test_windows_that_resemble_meet_by_rare_tokens(spark, monkeypatch):
    rng = np.random.default_rng(16)
    pool = rng.integers(1, 2**63, 400).astype(np.uint64)
    base = [rng.choice(pool[:: 1 + k % 3], 91) for k in range(12)]
    around = []
    for k in range(160):
        piece = base[rng.integers(12)].copy()
        for _ in range(rng.integers(0, 9)):  # from equal to hardly alike, at other places, some with tokens that repeat
            piece[rng.integers(91)] = rng.choice(pool[:5]) if k % 2 else rng.integers(1, 2**63)
        shift = rng.integers(0, 30)
        around.append(np.roll(piece, shift)[: rng.integers(46, 92)] if k % 5 else piece[shift : shift + 60])
    around += [np.full(91, pool[0]), np.full(50, pool[0]), np.repeat(pool[:30], 3), np.repeat(pool[:23], 2)]
    n = len(around)
    window, token = passages.rarest(around, pool[::7])
    found = [set(token[window == k].tolist()) for k in range(n)]
    wanted = {(i, j) for i in range(n) for j in range(i) if passages.passages_of(around[i], around[j])}
    assert 100 < len(wanted) < n * n // 4
    assert all(found[i] & found[j] for i, j in wanted)
    monkeypatch.setattr(passages, "PREFIXED", 0)
    monkeypatch.setattr(passages, "CELL_WINDOWS", 8)
    rows = [(k, 7, k, k, 0, k % 9 > 0, x.tobytes()) for k, x in enumerate(around)]
    dealt = passages._dealt(spark.createDataFrame(rows, "w long, key long, root long, node long, low int, many boolean, around binary"))
    cells = {}
    for r in dealt.collect():
        cells.setdefault((r["key"], r["cell"]), []).append(r["node"])
    met = {(max(i, j), min(i, j)) for x in cells.values() for i in x for j in x if i != j}
    # A token's windows go one way or the other, all of them.
    assert {(i, j) for i, j in wanted if (i % 9 > 0) == (j % 9 > 0)} <= met


def test_windows_of_many_rare_tokens_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(17)
    base, rows = rng.integers(1, 2**63, 91).astype(np.uint64), []
    for k in range(150):  # copies of one class, and other classes with changes here and there
        piece = base.copy()
        piece[rng.choice(91, 3 if k < 100 else 12, replace=False)] = rng.integers(1, 2**63, 3 if k < 100 else 12).astype(np.uint64)
        rows.append((k, 7, 0 if k < 100 else k, k, 0, True, piece.tobytes()))
    lone = rng.integers(1, 2**63, (40, 91)).astype(np.uint64)  # pairs of classes under another open token, with nothing else in common
    rows += [(150 + k, 8, 150 + k, 150 + k, 0, True, np.roll(lone[k // 2], k % 2 * 5).tobytes()) for k in range(80)]
    around = [np.frombuffer(r[-1], np.uint64) for r in rows]
    root = [r[2] for r in rows]
    wanted = {(i, j) for i in range(len(rows)) for j in range(i) if root[i] != root[j] and rows[i][1] == rows[j][1] and passages.passages_of(around[i], around[j])}
    monkeypatch.setattr(passages, "CELL_WINDOWS", 20)
    dealt = passages._dealt(spark.createDataFrame(rows, "w long, key long, root long, node long, low int, many boolean, around binary")).collect()
    found = {}
    for r in dealt:
        found.setdefault((r["key"], r["cell"]), []).append(r["node"])
    met = {(max(i, j), min(i, j)) for x in found.values() for i in x for j in x if i != j}
    assert len(wanted) > 300 and wanted <= met
    # Of the first token's windows each is in some cells of 20, not in those of each rare token beside it.
    assert sum(r["node"] < 150 for r in dealt) <= 100 * 3 + 50 * (3 + 5)
    # Those of the second meet by rare tokens, as this costs less.
    assert sum(r["node"] >= 150 for r in dealt) == 80


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, w = int(rng.integers(0, 90)), int(rng.integers(2, 15))
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        wanted = []
        for c in range(n):
            a = b = c
            while a > 0 and h[a - 1] > h[c]:
                a -= 1
            while b < n - 1 and h[b + 1] > h[c]:
                b += 1
            if b - a + 1 >= w:
                wanted.append((a, c, b))
        assert sorted(zip(*(x.tolist() for x in passages.compact_windows(h, w)))) == sorted(wanted)


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {}
    for doc_id, text, *_ in corpus():
        ids.setdefault(doc_id, []).append(model.encode(text or "", add_special_tokens=False).ids + [2])
    out = packing.packed_documents(docs).collect()
    assert sum(r["length"] for r in out) == sum(len(x) for xs in ids.values() for x in xs)
    for r in out:
        assert r["ids_crc32"] in {zlib.crc32(array("I", x[r["start"] : r["start"] + r["length"]]).tobytes()) for x in ids[r["doc_id"]]}
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(len(x) for xs in ids.values() for x in xs) / 1024 + 1


def test_best_fit_is_bounded():
    rng = random.Random(2)
    fit, open_, closed = packing.BestFit(100, 5), [], 0
    for k in range(500):
        n = rng.randint(1, 100)
        fit.add(k, n)
        # The same by plain loops: the fullest bin that still takes the piece; the fullest closes when a sixth is open.
        fitting = [x for x in open_ if x >= n]
        free = min(fitting, default=100)
        if fitting:
            open_.remove(free)
        if free > n:
            open_.append(free - n)
        if len(open_) > 5:
            open_.remove(min(open_))
            closed += 1
        assert sorted(open_) == sorted(f for f, held in enumerate(fit.by_free) for _ in held)
    assert fit.n_closed == closed > 100
    assert sum(len(b) for b in fit.bins) == 500 and all(sum(n for _, n in b) <= 100 for b in fit.bins)


def test_bins_close_and_fill():
    rng = random.Random(3)
    lengths = [rng.randint(1, 1023) for _ in range(packing.GROUP_PIECES)]
    fit = packing.BestFit(packing.WIDTH, packing.OPEN_BINS)
    for k in packing.arrival(lengths):
        fit.add(k, lengths[k])
    assert fit.n_closed > 1000 and len(fit.bins) <= 1.02 * sum(lengths) / packing.WIDTH


def test_tokenizers_agree():
    import pyarrow.parquet as pq

    tool = packing.token_bytes(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    odd = ["", " ", "\n\n  \t x", "a" * 5000, "ab1" * 3000, "é" * 700, "ſ't'S", "<|endoftext|>", "</s><s>", "don't WON'T", "\u00ad\u0130\u1e9e", "".join(chr(rng.randrange(1, 0x250)) for _ in range(3000)), "".join(chr(rng.choice([*range(1, 0xD800), *range(0xE000, 0x11000)])) for _ in range(3000))]
    path = "/root/testdata/sf0.001/documents.parquet"
    held = [x or "" for x in pq.read_table(path)["text"].to_pylist()] if os.path.exists(path) else []
    for text in odd + held:
        assert tool.document(text) == tool.ids(text)


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><header>Site name</header><nav><a href=/a>Home</a></nav>
<article><h1>Title &amp; more</h1><p>The quick fox and the lazy dog are in the house of the king and it is the end of the story.<br>
Short one.<p>And so it was that all of them went to the sea with the ship.</p><div class="ad">Buy the best of the things that you can get in the shop now</div></article>
<div id="comments"><p>I think that it is the best of all the texts that I have seen in the last year or so, and more of it is what I want.</p></div>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text(spark):
    text = html.main_text(PAGE)
    assert text.split("\n") == ["Title & more", "The quick fox and the lazy dog are in the house of the king and it is the end of the story. Short one.", "And so it was that all of them went to the sea with the ship."]
    pages = spark.createDataFrame([(1, None), (2, ""), (3, PAGE), (4, "plain < text"), (5, "<p>unclosed <b")], "page_id long, html string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.with_main_text(pages, ["page_id"]).collect()}
    assert out[1] == out[2] == ("", 0) and out[3] == (text, len(text))
    assert html.inherit(["bad", "ambiguous", "good", "ambiguous"], [5, 5, 5, 5], "bad")[3] == "good"


def test_inherit_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 12)
        labels = [rng.choice(["good", "bad", "ambiguous", "ambiguous"]) for _ in range(n)]
        sizes = [rng.randint(1, 4) for _ in range(n)]
        wanted = []
        for k, label in enumerate(labels):
            before = [(sum(sizes[j + 1 : k]), labels[j]) for j in range(k) if labels[j] != "ambiguous"][-1:]
            after = [(sum(sizes[k + 1 : j]), labels[j]) for j in range(k + 1, n) if labels[j] != "ambiguous"][:1]
            near = min(before + after, key=lambda x: x[0], default=(0, "good"))  # the preceding one on a tie
            wanted.append(near[1] if label == "ambiguous" else label)
        assert html.inherit(labels, sizes, "good") == wanted


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><p>Hello world, a short page.</p></body>", "Hello world, a short page."),
        ("plain text without tags", "plain text without tags"),
        ('<div id="content">' + "zork blip fnord " * 20 + "</div>", ("zork blip fnord " * 20).strip()),
        ("<div><a href=/>Меню сайта</a></div><p>" + "Привет мир это текст " * 22 + "</p><p>Ещё абзац.</p>", ("Привет мир это текст " * 22).strip() + "\nЕщё абзац."),
        ("<ul><li><a href=/>首页</a></li></ul><p>" + "这是一个没有文章元素的页面。" * 9 + "</p><footer>版权</footer>", "这是一个没有文章元素的页面。" * 9),
        ("<p>" + "bu sayfa bir makale değildir ama yine de okunur " * 5 + "</p><nav>menü</nav>", ("bu sayfa bir makale değildir ama yine de okunur " * 5).strip()),
        ("<!--><p>after a comment</p><!-- <p>no</p> --!><p>ends</p>", "after a comment\nends"),
        ('<p title="unclosed>text</p>', "text"),
        ("<p>a\x1cb\u2003c\u00a0d</p>", "a\x1cb c d"),
        ("<svg><p>an element that never ends</p>", "an element that never ends"),
        ("<script>x<p>no</p>", ""),
    ],
)
def test_pages_without_an_article(page, text):
    assert html.main_text(page) == text


def test_pages_take_linear_time(spark):
    began = time.process_time()
    assert html.main_text("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
    assert html.main_text('<div class="x y">' * 100_000 + "deep") == "deep"
    assert html.main_text("<svg>" * 50_000 + "<a b='" * 50_000 + "<!-" * 50_000 + "x") != "x" * 2
    assert time.process_time() - began < 6
    pages = spark.createDataFrame([(1, "u", "<p>one</p>", "own")], "page_id long, url string, html string, text string")
    out = html.with_main_text(pages, ["page_id", "url"])
    assert out.collect()[0].asDict() == {"page_id": 1, "url": "u", "text": "one", "n_chars": 3}
    assert html.with_main_text(pages.limit(0), ["page_id", "url"]).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.8
    votes = np.empty((4000, 4), int)
    for k, right in enumerate((0.95, 0.9, 0.85, 0.9)):
        good = np.where(truth, 1, np.where(rng.random(4000) < right, 0, 1))
        votes[:, k] = np.where(rng.random(4000) < 0.1, 2, good)
    patterns = ["".join(map(str, v)) for v in votes]
    model = weaklabels.fit_labels(Counter(patterns))
    assert ((model.posterior(patterns) > 0.5) == truth).mean() > 0.97


def test_classified(docs):
    out = weaklabels.classified(docs, sample_rows=200)
    assert out.count() == docs.count() and out.where("kept IS NULL").count() == 0


def test_classified_against_labels(spark):
    """Held-out accuracy: words are learned from one half of the labels, the other half judges."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = "pmod(xxhash64(doc_id), 2) = 0"
    out = {r["doc_id"]: r for r in weaklabels.classified(docs, labels=labels.where(half)).collect()}
    held = [(out[r["doc_id"]], r["quality"], r["toxic"]) for r in labels.where(f"NOT {half}").collect()]
    share = lambda rows: sum(r["kept"] for r in rows) / len(rows)
    assert share([r for r, quality, toxic in held if quality == 1 and toxic == 0]) > 0.93
    assert share([r for r, quality, _ in held if quality == 0]) < 0.15
    assert share([r for r, _, toxic in held if toxic == 1]) < 0.30


def test_labelled_sample_is_of_labelled_rows(spark):
    docs = spark.createDataFrame([(k, f"plain words number {k}" + (" grumbleword" if k < 20 else "")) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k < 20)) for k in range(40)], "doc_id long, quality int, toxic int")
    assert "grumbleword" in weaklabels.fit(docs, labels=labels, sample_rows=100, labelled_rows=40).learned
