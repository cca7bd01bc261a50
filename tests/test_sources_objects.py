import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.__main__ import main
from vexel.objects import ColumnEmbedding, DirectoryImageReader, DirectoryTextReader, HashingEmbedding, ObjectIndex, RandomEmbedding, TableReader, match_uri
from vexel.objects.readers import split_text
from vexel.operators import graph, topk
from vexel.plans import create, ingest, open_index
from vexel.sources import autodetect, blocks_to_vectors, coo_to_vectors, import_vamana, load_as_matrix, read_graph, read_ids, read_vectors, source_metadata, write_vectors
from vexel.sources import vectors as v
from vexel.streaming import update_stream


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs", "u8bin", "i8bin", "f32bin"])
def test_vector_files(spark, tmp_path, kind):
    x = (np.arange(300).reshape(60, 5) * 7 % 100).astype(v.FORMATS[kind][0])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"external_id long, vector array<{v.FORMATS[kind][1]}>")
    path = str(tmp_path / f"x.{kind}")
    write_vectors(df, path)
    raw = open(path, "rb").read()
    if kind.endswith("vecs"):
        assert raw == b"".join(struct.pack("<i", 5) + r.tobytes() for r in x)
    else:
        assert raw == struct.pack("<II", 60, 5) + x.tobytes()
    assert autodetect(path) == kind and source_metadata(spark, path)[:2] == (60, 5)
    got = read_vectors(spark, path, range_bytes=200)
    assert sorted(map(tuple, got.selectExpr('external_id', 'vector[1]').collect())) == [(i, r[1].item()) for i, r in enumerate(x)]
    assert got.schema["vector"].dataType.elementType.simpleString() == v.FORMATS[kind][1]
    assert got.rdd.getNumPartitions() > 1
    assert (load_as_matrix(spark, path) == x).all() and (load_as_matrix(spark, path, 7) == x[:7]).all()
    assert read_vectors(spark, path, dimensions=3).where("size(vector) = 3").count() == 60


def test_ids_tables_and_broken_files(spark, tmp_path):
    ids = np.array([5, 1 << 63, 7], "<u8")
    (tmp_path / "ids.u64bin").write_bytes(struct.pack("<II", 3, 1) + ids.tobytes())
    got = {r.pos: r.external_id for r in read_ids(spark, str(tmp_path / "ids.u64bin")).collect()}
    assert got == {0: 5, 1: -(1 << 63), 2: 7}
    x = np.eye(3, 4, dtype="<f4")
    (tmp_path / "x.f32bin").write_bytes(struct.pack("<II", 3, 4) + x.tobytes())
    index = ingest(spark, "FLAT", str(tmp_path / "i"), source_uri=str(tmp_path / "x.f32bin"), external_ids_uri=str(tmp_path / "ids.u64bin"))
    assert index.query_matrix(x, 1)[1].ravel().tolist() == [5, 1 << 63, 7]
    (tmp_path / "cut.f32bin").write_bytes(struct.pack("<II", 9, 4) + x.tobytes())
    (tmp_path / "odd.fvecs").write_bytes(struct.pack("<i", 4) + b"123")
    for bad in ("cut.f32bin", "odd.fvecs"):
        with pytest.raises(Exception, match="header says|records"):
            read_vectors(spark, str(tmp_path / bad)).collect()
    with pytest.raises(ValueError):
        read_vectors(spark, "x", "other")
    spark.createDataFrame([(1, [1.0, 2.0])], "external_id long, vector array<float>").write.parquet(str(tmp_path / "t"))
    assert source_metadata(spark, str(tmp_path / "t")) == (1, 2, "float") and read_vectors(spark, str(tmp_path / "t")).count() == 1


def test_sparse_keeps_its_width(spark):
    cells = spark.range(10).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(89))).alias("c")).withColumn("v", F.col("r") * 100 + F.col("c"))
    d = coo_to_vectors(cells, "r", "c", "v", 100)
    rows = {r.external_id: r.vector for r in d.collect()}
    assert all(len(x) == 100 and x[90:] == [0.0] * 10 for x in rows.values()) and rows[3][:3] == [300.0, 301.0, 302.0]


def test_blocks(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [7, 8]), ([5.0, 6.0], [9]), ([], [])], "vectors array<float>, external_ids array<long>")
    assert {r.external_id: r.vector for r in blocks_to_vectors(d).collect()} == {7: [1.0, 2.0], 8: [3.0, 4.0], 9: [5.0, 6.0]}


def test_graph_import(spark, tmp_path):
    x = np.arange(20, dtype="<f4").reshape(10, 2)
    (tmp_path / "g.data").write_bytes(struct.pack("<II", 10, 2) + x.tobytes())
    nodes = b"".join(np.array([len(n), *n], "<u4").tobytes() for n in ([[1]] + [[i - 1, i + 1] for i in range(1, 9)] + [[8]]))
    (tmp_path / "g").write_bytes(struct.pack("<QIIQ", 24 + len(nodes), 2, 4, 0) + nodes)
    e = read_graph(spark, str(tmp_path / "g"), str(tmp_path / "g.data"))
    assert e.count() == 18 and e.where("score = 8.0").count() == 18 and read_graph(spark, str(tmp_path / "g")).count() == 18
    q = spark.createDataFrame([(0, [18.2, 19.0])], "query_id long, vector array<float>")
    assert [r.external_id for r in graph.vamana_query(import_vamana(spark, str(tmp_path / "g")), q, 2).orderBy("rank").collect()] == [9, 8]
    (tmp_path / "bad").write_bytes(struct.pack("<QIIQ", 99, 2, 4, 0))
    with pytest.raises(ValueError):
        read_graph(spark, str(tmp_path / "bad"))


def test_images_and_counts(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    r = DirectoryImageReader(str(tmp_path))
    assert [(x.bytes, bytes(x.image)) for x in r.objects(spark).collect()] == [(3, b"123")] and r.metadata(spark).count() == 1
    assert type(r)(**r.kwargs).kwargs == r.kwargs
    df, o = topk.counted(spark.range(9).selectExpr("id AS query_id", "id AS external_id", "1D AS distance"))
    assert topk.top_k(df, 1).count() == 9 and o.get["evaluated"] == 9


def test_command_line(spark, tmp_path, capsys):
    x = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "external_id long, vector array<float>")
    write_vectors(x, str(tmp_path / "x.fvecs"))
    main(["ingest", "IVF_FLAT", str(tmp_path / "x.fvecs"), str(tmp_path / "i"), "--partitions", "2", "--timestamp", "5"])
    main(["query", str(tmp_path / "i"), str(tmp_path / "x.fvecs"), str(tmp_path / "out"), "-k", "1", "--nprobe", "2"])
    assert spark.read.parquet(str(tmp_path / "out")).where("query_id = external_id and distance = 0").count() == 20
    main(["info", str(tmp_path / "i")])
    assert "ingestion_timestamps: [5]" in capsys.readouterr().out


def test_match_and_split():
    assert match_uri("/a/b.pdf") and match_uri("/a/b.pdf", "*.pdf") and match_uri("b.txt", "b*", ["c*"], [".txt"]) and match_uri("x", None) and match_uri("/a/b.jpg", suffixes=[".png", ".jpg"])
    assert not match_uri("/a/b.pdf", "*.txt") and not match_uri("b.pdf", "*", ["*.pdf"]) and not match_uri("b.pdf", suffixes=[".txt"]) and not match_uri("/b/a", "b*")
    text = "para one. " * 30 + "\n\n" + "para two. " * 30
    parts = split_text(text, 200, 20)
    assert all(0 < len(p) <= 200 for p in parts) and split_text("") == [] and split_text("abc") == ["abc"]
    assert set("".join(parts).split()) >= set(text.split())


def test_object_index(spark, tmp_path):
    rows = [(i, f"object {i}", [float(i)] * 4, i) for i in range(1000)]
    spark.createDataFrame(rows, "external_id long, name string, vector array<float>, test_attr long").write.parquet(str(tmp_path / "t"))
    reader, emb = TableReader(str(tmp_path / "t"), attributes=["test_attr"]), ColumnEmbedding(4)
    o = ObjectIndex.create(spark, str(tmp_path / "o"), "IVF_FLAT", reader, emb)
    o.update_index(index_timestamp=10, partitions=5)
    q = spark.createDataFrame([(42, [42.0] * 4)], "external_id long, vector array<float>")
    ids = lambda r: sorted(x.external_id for x in r.collect())
    assert ids(o.query(q, 21, nprobe=5)) == list(range(32, 53))
    for mode in ("pre", "post"):
        assert ids(o.query(q, 21, nprobe=5, where="test_attr >= 42", filter_mode=mode)) == list(range(42, 63))
    assert ids(o.query(q, 21, nprobe=5, filter_fn=lambda r: r["test_attr"] >= 42)) == list(range(42, 63))
    full = o.query(q, 1, nprobe=5, return_metadata=True, return_objects=True).first()
    assert full.external_id == 42 and full.test_attr == 42 and full.name == "object 42"
    again = ObjectIndex.open(spark, str(tmp_path / "o"))
    assert again.reader.kwargs == reader.kwargs and ids(again.query(q, 3, nprobe=5)) == [41, 42, 43]
    with pytest.raises(ValueError, match="allowed"):
        ObjectIndex.open(spark, str(tmp_path / "o"), allowed=("other",))
    spark.createDataFrame([(5000, "new", [42.0] * 4, 0)], "external_id long, name string, vector array<float>, test_attr long").write.parquet(str(tmp_path / "t2"))
    o.update_object_reader(TableReader(str(tmp_path / "t2"), attributes=["test_attr"]))
    o.update_index(use_updates=True)
    assert ids(o.query(q, 2, nprobe=40)) == [42, 5000]


class Shifted(ColumnEmbedding):
    """Ten vectors an object, far apart."""

    def embed(self, batch):
        x = super().embed(batch)
        return np.concatenate([x + 100_000 * j for j in range(10)]), np.tile(batch["external_id"].to_numpy(), 10)


def test_several_vectors_per_query(spark, tmp_path):
    rows = [(i, [float(i)] * 3) for i in range(100)]
    spark.createDataFrame(rows, "external_id long, vector array<float>").write.parquet(str(tmp_path / "t"))
    o = ObjectIndex.create(spark, str(tmp_path / "o"), "FLAT", TableReader(str(tmp_path / "t")), ColumnEmbedding(3))
    o.update_index()
    o.embedding = Shifted(3)
    q = spark.createDataFrame([(7, [42.0] * 3), (8, [10.0] * 3)], "external_id long, vector array<float>")
    got = o.query(q, 5)
    assert "score" in got.columns and {r.query_id for r in got.collect()} == {7, 8}
    assert got.where("rank <= 5").count() == 10


def test_texts(spark, tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("the quick brown fox " * 100)
    (d / "sub" / "b.txt").write_text("vectors and their neighbours")
    (d / "c.bin").write_bytes(b"\xff\x00")
    r = DirectoryTextReader(str(d), include="*.txt", chunk_size=200, chunk_overlap=20)
    o = ObjectIndex.create(spark, str(tmp_path / "o"), "FLAT", r, HashingEmbedding(32), metric="COSINE")
    o.update_index()
    assert o.index.size > 10 and r.objects(spark).select("external_id").distinct().count() == o.index.size
    q = spark.createDataFrame([(0, "neighbours of vectors")], "external_id long, text string")
    hit = o.query(q, 1, return_objects=True, return_metadata=True).first()
    assert hit.uri.endswith("b.txt") and hit.text == "vectors and their neighbours"
    assert DirectoryTextReader(str(d), max_files=1).files(spark).count() == 1
    assert RandomEmbedding(5).embed(__import__("pandas").DataFrame({"external_id": [1, 2, 1]}))[0].tolist() == RandomEmbedding(5).embed(__import__("pandas").DataFrame({"external_id": [1]}))[0].tolist()


def test_stream_of_updates(spark, tmp_path):
    index = create(spark, str(tmp_path / "i"), "FLAT", 2)
    src = str(tmp_path / "src")
    schema = "external_id long, vector array<float>, ts long"
    spark.createDataFrame([(1, [1.0, 1.0], 10), (2, [2.0, 2.0], 10), (3, [1.0], 10)], schema).coalesce(1).write.parquet(src)

    def run():
        q = update_stream(spark.readStream.schema(schema).parquet(src), index, str(tmp_path / "cp"))
        q.awaitTermination(120)
        index.refresh()
        return sorted(r.external_id for r in index.vectors().collect())

    assert run() == [1, 2]
    index.consolidate_updates()
    spark.createDataFrame([(1, [], 50), (4, [4.0, 4.0], 50), (5, [5.0, 5.0], 3)], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [2, 4]
    assert run() == [2, 4]
    assert [r.external_id for r in open_index(spark, str(tmp_path / "i")).query(np.array([[4, 4]], np.float32), 1).collect()] == [4]


def test_texts_of_files_by_their_type(spark, tmp_path):
    import zipfile

    from vexel.objects import text_of

    (tmp_path / "a.html").write_text("<html><head><title>t</title><style>p{}</style></head><body><h1>One &amp; two</h1><p>three <b>four</b></p><script>var x = '<p>';</script></body></html>")
    (tmp_path / "b.md").write_text("# Title\n\n- a [link](http://x.org) and **bold** `code`\n\n```py\nx\n```\n> said\n")
    (tmp_path / "c.txt").write_text("<p>plain</p>")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>first </w:t></w:r><w:r><w:t>part</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p></w:body></w:document>')
    got = {r.uri.rsplit("/", 1)[-1]: r.text for r in DirectoryTextReader(str(tmp_path)).objects(spark).collect()}
    assert got["a.html"] == "One & two\nthree four" and got["c.txt"] == "<p>plain</p>" and got["d.docx"] == "first part\nsecond"
    assert "Title" in got["b.md"] and "a link and bold code" in got["b.md"] and not any(c in got["b.md"] for c in "#*`>[")
    only = DirectoryTextReader(str(tmp_path), include="[a-c].*", exclude=["b*"], suffixes=[".html", ".md"]).objects(spark).collect()
    assert [r.uri.rsplit("/", 1)[-1] for r in only] == ["a.html"]
    with pytest.raises(RuntimeError, match="pypdf"):
        text_of(b"%PDF-1.4", "x.pdf")


def test_adapters_of_models_that_are_not_here(monkeypatch):
    import sys
    from types import ModuleType

    import pandas as pd

    from vexel.objects import ColPaliEmbedding, ImageModelEmbedding, LangChainEmbedding, ResNetEmbedding

    for e in (LangChainEmbedding("no_such_library.Model", 3), ImageModelEmbedding("m", 3), ResNetEmbedding(), ColPaliEmbedding("m")):
        with pytest.raises(RuntimeError, match="needs the library"):
            e.load()
    fake = ModuleType("fake_chain")

    class Model:
        def __init__(self, scale):
            self.scale = scale

        def embed_documents(self, texts):
            return [[len(t) * self.scale, 1, 0] for t in texts]

    fake.Model = Model
    monkeypatch.setitem(sys.modules, "fake_chain", fake)
    e = LangChainEmbedding("fake_chain.Model", 3, {"scale": 2})
    e.load()
    assert e.embed(pd.DataFrame({"external_id": [1, 2], "text": ["abc", None]})).tolist() == [[6, 1, 0], [0, 1, 0]]
