from framewell.plans import database
from framewell.sources import structures, tables
from framewell.streaming import ingest
from tests import crystals


def test_database_resumes(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.cif").write_text(crystals.cubic())
    (folder / "bad.cif").write_text("nothing")
    first = database.run(spark, str(folder), out, ["fingerprint"])["fingerprint"]
    assert first.count() == 1
    (folder / "b.cif").write_text(crystals.cubic(2))
    todo = database.pending(spark, structures.read(spark, str(folder), "*.cif", False), out, "fingerprint")
    assert todo.count() == 1
    again = database.run(spark, str(folder), out, ["fingerprint"])["fingerprint"]
    assert again.count() == 2 and len({r["fingerprint_hash"] for r in again.collect()}) == 1
    assert spark.read.parquet(f"{out}/structures").where("error IS NOT NULL").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/fingerprint/summary").count() == 2


def test_upsert_survives_an_end_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, seq int")
    tables.upsert(spark, rows((1, "a", 1), (2, "b", 1)), path, ["k"], "seq")
    (tmp_path / "t").rename(tmp_path / "t.old")  # the new table had not taken its place
    tables.upsert(spark, rows((2, "c", 2), (3, "d", 2)), path, ["k"], "seq")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert not (tmp_path / "t.old").exists()


def test_analyses_of_the_same_structures_share_them(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cif").write_text(crystals.cubic())
    made = []
    parent = database.Framework
    monkeypatch.setattr(database, "ANALYSES", {k: lambda f: (made.append(f), f.overlaps())[1] for k in ("x", "y")})
    monkeypatch.setattr(database, "Framework", lambda todo: parent(todo))
    database.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["x", "y"])
    assert made[0] is made[1]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    analyse = lambda parsed: {"structures": structures.structures(parsed)}
    for k, name in enumerate("ab"):
        (folder / f"{name}.cif").write_text(crystals.cubic())
        ingest.ingest(spark, str(folder), out, analyse).awaitTermination()
        assert spark.read.parquet(f"{out}/structures").count() == k + 1
