import random

import sentencepiece

from galeframe.llm import pieces

MODEL = pieces.public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "the", "é", "▁", "\n", "\t", "日", "🙂", "'", "1", " of", "\x00", "tion"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_chunks_give_the_ids_of_the_library():
    draw = random.Random(7)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "  ", "a ", " a", "▁", "x" * 30_000, "word " * 20_000]
    table = pieces.ChunkTable(MODEL, table_rows=50)  # begins anew often
    for at in range(0, len(texts), 100):
        assert table.encode(texts[at : at + 100]).to_pylist() == library().encode(texts[at : at + 100])
    assert table.encode([]).to_pylist() == []


def test_encode_and_decode_keep_other_columns(spark):
    rows = [(1, "Some text.", "old"), (2, None, "old"), (3, "", None), (3, "Some text.", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).orderBy("doc_id", "decoded").toPandas()
    sp = library()
    assert [list(x) for x in out["ids"]] == [sp.encode(t) for t in ("Some text.", "", "", "Some text.")]
    assert out["decoded"].tolist() == [sp.decode(sp.encode(t)) for t in ("Some text.", "", "", "Some text.")]
    assert pieces.decode(pieces.encode(df.limit(0), MODEL), MODEL).count() == 0


def test_query_against_the_library(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r[1:] for r in pieces.query(spark, folder).toPandas().itertuples(index=False)}
    sp = library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{folder}/documents.parquet").toPandas().itertuples():
        ids = sp.encode(r.text or "")
        assert tuple(got[r.doc_id]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
