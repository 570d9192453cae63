import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from starling.llm import bpe

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("be", "ko", "ri", "su") for b in ("la", "mi", "no", "tu") for c in ("r", "s", "n", "", "th")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(30)) for i in range(5)]
    docs, expect = [], {}

    def put(t, fate):
        docs.append((len(docs), t, "en", f"s{len(docs) % 7}", len(t or "")))
        expect[len(docs) - 1] = fate

    for _ in range(60):
        put(text(rng.randrange(60, 120)), "stays")
    for _ in range(12):
        t = text(80).split()
        for w in ("idiot", "mor0n", "scum"):
            t.insert(rng.randrange(80), w)
        put(" ".join(t), "toxic")
    base = docs[3][1].split()
    put(" ".join(base), "copy")
    put(" ".join(base[:-1] + ["other"]), "copy")
    put(text(50) + " " + items[2][1] + " " + text(20), "leak")
    half = items[3][1].split()
    put(" ".join(half[15:]) + " " + text(40) + " " + " ".join(half[:15]), "leak")
    put(text(50) + " token = 'q8Zk2Lw0pX7' " + text(10), "masked")
    for _ in range(4):
        put(text(50) + " token = 'example0000' " + text(10), "stays")
    put(None, "stays")
    put("", "stays")
    return docs, items, expect


def test_every_stage(spark, tmp_path):
    docs, items, expect = corpus()
    at = lambda name: f"file://{tmp_path}/{name}.parquet"
    spark.createDataFrame(docs, KIND).write.parquet(at("documents"))
    spark.createDataFrame([(i, int(expect[i] == "toxic"), 1) for i in range(0, 70)], "doc_id long, toxic int, quality int").write.parquet(at("labels"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(at("benchmark"))
    df, gone, columns = spark.read.parquet(at("documents")), {"toxicity": "toxic", "near_dedup": "copy", "decontaminate": "leak"}, KIND
    left = dict(expect)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "tokens"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, f"file://{tmp_path}").write.parquet(at(f"stage{n}"))
        df = spark.read.parquet(at(f"stage{n}"))
        left = {i: f for i, f in left.items() if f != gone.get(name)}
        assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == sorted(left), name
        if name != "tokens":
            assert df.columns == [c.split()[0] for c in columns.split(", ")], name
            texts = {r["doc_id"]: r["text"] for r in df.collect()}
    masked = next(i for i, f in expect.items() if f == "masked")
    assert "q8Zk2Lw0pX7" not in texts[masked] and "[REDACTED]" in texts[masked]
    assert all(texts[i] == docs[i][1] for i in left if i != masked)
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in df.collect():
        assert r["exact"] and r["token_ids"] == library.encode_ordinary(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["token_ids"])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(left)


def test_repeated_and_empty(spark, tmp_path):
    docs = [(1, "a b c d e f g h i j k l", "en", "s", 1)] * 3 + [(None, "a b c d e f g h i j k l", None, None, None)]
    at = lambda name: f"file://{tmp_path}/{name}.parquet"
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(at("labels"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(at("benchmark"))
    df = spark.createDataFrame(docs, KIND)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, df, f"file://{tmp_path}").collect()) == ["1", "None"]
    df.limit(0).write.parquet(at("documents"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
