"""Region files, configurations, the assembly functions and the stream."""

from __future__ import annotations

import pytest

from axisweave.plans import assembly
from axisweave.sources import regions
from axisweave.sources.regions import Config
from axisweave.streaming.sites import streaming_site_counts


def test_bed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "+", 5, 9, "x", 1.5), ("c2", ".", 1, 1, None, None)], "chr string, strand string, start int, stop int, name string, score double")
    regions.write_bed(df, str(tmp_path / "b"))
    got = sorted((r["chr"], r["start"], r["stop"], r["strand"]) for r in regions.read_bed(spark, str(tmp_path / "b")).collect())
    assert got == [("c1", 5, 9, "+"), ("c2", 1, 1, ".")]
    (tmp_path / "three.bed").write_text("# note\nc1\t0\t10\n")
    assert regions.read_bed(spark, str(tmp_path / "three.bed")).first().asDict() == {"chr": "c1", "start": 1, "stop": 10, "name": None, "score": None, "strand": "."}


def test_bed12_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c", "-", "t", 20, 25), ("c", "-", "t", 5, 9)], "chr string, strand string, name string, start int, stop int")
    regions.write_bed12(df, str(tmp_path / "b"))
    got = [(r["block"], r["start"], r["stop"]) for r in regions.read_bed12_blocks(spark, str(tmp_path / "b")).orderBy("block").collect()]
    assert got == [(0, 5, 9), (1, 20, 25)]


def test_gtf(spark, tmp_path):
    df = spark.createDataFrame([("c", "exon", 1, 9, "+", {"b": "2", "a": "x y"})], "chr string, type string, start int, stop int, strand string, attributes map<string,string>")
    regions.write_gtf(df, str(tmp_path / "g"))
    r = regions.read_gtf(spark, str(tmp_path / "g")).first()
    assert (r["start"], r["stop"], r["attributes"]) == (1, 9, {"a": "x y", "b": "2"})
    (tmp_path / "k.gtf").write_text('c\ts\texon\t1\t2\t.\t-\t.\tgene_id=g1;transcript_id=t1\nc\ts\texon\t5\t9\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; \n')
    t = regions.transcripts(regions.read_gtf(spark, str(tmp_path / "k.gtf"))).first()
    assert (t["gene_id"], t["transcript_id"], t["start"], t["stop"], t["exons"]) == ("g1", "t1", 1, 9, 2)


def test_config():
    c = Config(threshold=3)
    assert Config.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        Config(alpha=2.0)


def test_assembly(spark):
    reads = [("c", "+", 100 + i, "20M") for i in range(0, 80, 2)] + [("c", "+", 170 + i, f"{30 - i}M100N20M") for i in range(0, 20)] + [("c", "+", 300 + i, "20M") for i in range(0, 300, 1)]
    a = spark.createDataFrame(reads, "chr string, strand string, start int, cigar string")
    out = assembly.assemble(a, Config(merge_radius=5, min_terminal=50))
    assert [(r["start"], r["stop"]) for r in out.junctions.where("accepted").collect()] == [(200, 299)]
    found = {r["type"]: (r["start"], r["stop"]) for r in out.exons.collect()}
    assert found["5p_exon"] == (100, 199) and found["3p_exon"][0] == 300
    located = assembly.loci(out.exons, out.junctions.where("accepted"))
    assert located.select("locus_id").distinct().count() == 1
    paths = assembly.isoforms(located, out.junctions.where("accepted")).collect()
    assert len(paths) == 1 and len(paths[0]["path"]) == 2
    ref = spark.createDataFrame([("c", "+", 100, 199, "t1", "g1")], "chr string, strand string, start int, stop int, transcript_id string, gene_id string")
    assert assembly.diff(located, ref).first()["same_5p"] == ["t1"]
    assert out.change_points.count() >= 0 and out.unspliced.count() == 0


def test_compare(spark):
    exon = spark.createDataFrame([("c", "+", 1, 1200, "3p_exon")], "chr string, strand string, start int, stop int, type string")
    one = [("c", "+", s, s + 5) for s in range(1, 600) for _ in range(3)] + [("c", "+", s, s + 5) for s in range(600, 1190, 20)]
    two = [("c", "+", s, s + 5) for s in range(1, 600) for _ in range(3)] + [("c", "+", s, s + 5) for s in range(600, 1190) for _ in range(1)]
    reads = [spark.createDataFrame(x, "chr string, strand string, start int, stop int") for x in (one, two)]
    r = assembly.compare((exon, reads[0]), (exon, reads[1]), Config(bin_width=20)).collect()
    assert len(r) == 1 and abs(r[0]["pos"] - 600) <= 40 and r[0]["usage_1"] > 0.9 and 0.5 < r[0]["usage_2"] < 0.8


def test_stream(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 00:10:00", "c", "+", 5), ("2024-01-01 00:20:00", "c", "+", 5), ("2024-01-01 05:00:00", "c", "+", 9)], "ts string, chr string, strand string, site int").selectExpr("cast(ts as timestamp) ts", "chr", "strand", "site")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streaming_site_counts(stream).writeStream.format("memory").queryName("sites").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["site"], r["n"]) for r in spark.sql("select * from sites").collect()] == [(5, 2)]


def test_long_terminal_exons_have_change_points(spark, monkeypatch):
    """An exon of more than max_bins bins is segmented in wider bins."""
    exon = spark.createDataFrame([("c", "+", 300, 1519, "3p_exon")], "chr string, strand string, start int, stop int, type string")
    monkeypatch.setattr(assembly.exons, "spliced_exons", lambda segments, accepted: exon)
    reads = [("c", "+", 300 + i, "20M") for i in range(600) for _ in range(4)] + [("c", "+", 900 + i, "20M") for i in range(0, 600, 10)]
    a = spark.createDataFrame(reads, "chr string, strand string, start int, cigar string")
    points = assembly.assemble(a, Config(max_bins=30)).change_points.collect()
    assert [abs(r["pos"] - 910) <= 60 for r in points] == [True]
