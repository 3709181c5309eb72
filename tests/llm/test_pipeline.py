import re
import zlib
from array import array
from collections import Counter

import corpus_pipeline
from test_operators import corpus, plain_fertility

from lodestream.llm import mixing
from lodestream.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages_against_brute_force(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    sentences = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    pairs = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    known = "the house and garden of people with water under trees where children walk every morning before school while birds sing over green fields near rivers that carry boats slowly toward towns full of markets bread fish stones windows".split()
    import random

    rng = random.Random(17)
    prose = lambda n: [rng.choice(known) for _ in range(n)]
    rows = list(corpus())
    for k in range(60):
        words = prose(rng.randint(40, 130))
        rows.append((500 + 4 * k, " ".join(words), "en", f"s{k % 3}", 1))
        rows.append((501 + 4 * k, " ".join(words), "en", f"s{k % 3}", 2))
        words[rng.randrange(len(words))] = "changed"
        rows.append((502 + 4 * k, " ".join(words), "en", None, 3))
    docs = written(spark, tmp_path, rows)

    def kept(row):
        text = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        return len(words) >= 50 and 100 * len(again) <= 50 * len(words) and plain_fertility(words, text, row[2], sentences, pairs)[1]

    wanted = [r for r in rows if kept(r)]
    best = {}
    for r in wanted:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    by_stage = [wanted, list(best.values())]
    grams = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in ([*r[1].encode().split()] for r in by_stage[1])]
    root = list(range(len(grams)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            if sum((a & grams[j]).values()) >= 0.8 * sum((a | grams[j]).values()):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(by_stage[1]):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    by_stage.append([r for i, r in enumerate(by_stage[1]) if r[0] is None or r[0] == least[find(i)]])
    for (_, stage), rows_ in zip(corpus_pipeline.STAGES, by_stage, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{len(rows_)}-{stage.__name__}"))
        docs = spark.read.parquet(str(tmp_path / f"out{len(rows_)}-{stage.__name__}"))
        assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, rows_))
    # The mix: each row as often as its source's draws say.
    times = {r["doc_id"]: len(r["shards"]) for r in mixing.mixed(docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    mixed = [tuple(r) for r in mixed.collect()]
    assert Counter(r[0] for r in mixed) == Counter({i: n for i, n in times.items() if n})
    # Packing: all pieces of the mix, none twice in a place.
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(pairs.encode(t, add_special_tokens=False).ids) + 1 for _, t, *_ in mixed)
    texts = {r[0]: r[1] for r in mixed}
    for r in packed:
        ids = pairs.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_empty_pipeline(spark, tmp_path):
    written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
