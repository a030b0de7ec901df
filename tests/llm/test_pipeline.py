import random

import corpus_pipeline
from graphmill.llm import queries
from graphmill.llm.common import stored

WORDS = "river stone cloud ember field grass house light water north south green yellow seven eleven".split()


def rows():
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(n))
    out = [(i, text(60), "en", "s", 1) for i in range(40)]
    out += [(100, out[3][1], "en", "s", 1), (101, out[3][1].upper(), "en", "s", 1), (102, out[4][1] + " more", "en", "s", 1)]
    out += [(200, text(20) + " " + BENCH + " " + text(20), "en", "s", 1)]
    out += [(300, f"{text(30)} password=0123456789abcdef01 {text(5)}", "en", "s", 1)]
    out += [(400, None, "en", "s", None), (401, "12 34 !", None, "s", 7), (None, text(30), None, None, None)]
    return out


BENCH = "what is the capital of the smallest country that borders both of the two largest lakes in the region"


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = rows()
    spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, BENCH.title()), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {d[0] for d in docs}
    gone = [{400, 401}, {100, 101, 102}, {200}, set()]
    for (name, stage), drop in zip(corpus_pipeline.STAGES[:-1], gone):
        df = stored(stage(spark, df, sf))
        want -= drop
        assert {r.doc_id for r in df.collect()} == want and df.schema.simpleString() == spark.read.parquet(f"{sf}/documents.parquet").schema.simpleString(), name
    text = {r.doc_id: r for r in df.collect()}
    assert "[SECRET]" in text[300].text and "0123456789abcdef" not in text[300].text and text[300].n_chars == len(text[300].text)
    assert all(text[i].text == t for i, t, *_ in docs if i in text and i != 300)
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in last} == want and all(r.n_tokens > 0 for r in last)


def test_names():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "bpe"]
