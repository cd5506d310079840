import io

from gleanix import cli


def test_build_ask_and_run(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.tsv").write_text("0\tsolar panels power solar farms\n1\twind farms power cities\n2\tthe of\n")
    (tmp_path / "s.txt").write_text("the\nof")
    (tmp_path / "q.tsv").write_text("1\tpowerful farming\n2\tthe of\n3\tunknown\n")
    paths = [str(tmp_path / n) for n in ("c.tsv", "index", "q.tsv", "run")]
    cli.main(["build", *paths[:2], "--stem", "--stop", str(tmp_path / "s.txt")])
    assert "3 documents" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("solar\nnothing here\n"))
    cli.main(["ask", paths[1], "--stem", "--scoring", "bm25", "--mode", "and"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("1\t0\t") and out[1] == "no result"
    cli.main(["run", paths[1], paths[2], paths[3], "--stem"])
    lines = sorted(line for p in (tmp_path / "run").glob("*.csv") for line in p.read_text().splitlines())
    assert lines == ["1\t0\t0\t1", "2\t0\t-1\t1"]
