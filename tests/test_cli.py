import pytest

from orewright import cli
from orewright.session import clear_shared, materialize


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    for i, text in enumerate(["the quick brown fox jumps", "the quick brown fox jumped", "something else entirely"]):
        (tmp_path / f"docs/{i}.txt").write_text(text)
    (tmp_path / "baskets").write_text("1 2 3\n1 2\n3\n")
    (tmp_path / "edges").write_text("% c\n" + "\n".join(f"{u} {v}" for u in range(8) for v in range(u)))
    (tmp_path / "points").write_text("\n".join(f"{x},{x % 2 * 9}" for x in range(12)))
    (tmp_path / "graph").write_text("6 6\n 2 6\n 1 3\n 2 4\n 3 5\n 4 6\n 5 1\n")
    for command, name in (("similarity", "docs"), ("itemsets", "baskets"), ("triangles", "edges"), ("clusters", "points")):
        extra = ["-window", "7"] if command == "triangles" else ["-k", "2"] if command == "clusters" else []
        cli.main([command, "-input", str(tmp_path / name), *extra, "-out", str(tmp_path / f"{command}-out")])
    assert spark.read.parquet(f"{tmp_path}/itemsets-out/rules").count() == 2
    assert spark.read.parquet(f"{tmp_path}/triangles-out/windows").orderBy("window_id").collect()[-1].estimate == 56.0
    assert spark.read.parquet(f"{tmp_path}/similarity-out/exact").count() == 1
    assert spark.read.parquet(f"{tmp_path}/clusters-out/clusters").count() == 12
    cli.main(["partition", "-graph", str(tmp_path / "graph"), "-rounds", "2", "-numPartitions", "2", "-out", str(tmp_path / "p")])
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/p/rounds")
    assert back.count() == 2 and "nodeSelectionPolicy" in back.columns
    cli.main(["itemsets", "-input", str(tmp_path / "baskets")])
    assert "rules" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_cleaning(spark):
    df = materialize(spark.range(3), "some")
    assert df.count() == 3
    clear_shared(spark)
    with pytest.raises(Exception):
        df.count()
