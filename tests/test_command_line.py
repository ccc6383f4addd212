from test_index import asked

from lexirun.__main__ import main
from lexirun.sources import formats


def test_build_count_locate(spark, tmp_path, capsys):
    (tmp_path / "texts").write_text("abracadabra\nabcabcababc\n")
    formats.write_patterns(asked(spark, [b"ab", b"zz", b"br"]), f"{tmp_path}/p.pat")
    main(["build", f"{tmp_path}/texts", f"{tmp_path}/index", "--strings", "--step", "4"])
    main(["count", f"{tmp_path}/index", f"{tmp_path}/p.pat"])
    main(["locate", f"{tmp_path}/index", f"{tmp_path}/p.pat", "--out", f"{tmp_path}/found"])
    lines = capsys.readouterr().out.splitlines()
    for head, row in (lines[:2], lines[2:4]):
        told = dict(zip(head.split("\t"), row.split("\t"), strict=True))
        assert (told["level"], told["n_pats"], told["n_occ"]) == ("csa", "3", "8")
    assert spark.read.parquet(f"{tmp_path}/found").count() == 8


def test_files_as_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"a\nb\xff")
    formats.write_patterns(asked(spark, [b"\nb\xff"]), f"{tmp_path}/p.pat")
    main(["build", f"{tmp_path}/in", f"{tmp_path}/index", "--level", "toehold"])
    main(["count", f"{tmp_path}/index", f"{tmp_path}/p.pat"])


def test_transforms_strategies_and_breakdown(spark, tmp_path, capsys):
    (tmp_path / "x.bwt").write_bytes(b"ccbc\0aaaabbb")
    formats.write_patterns(asked(spark, [b"ab", b"bc", b"ca"]), f"{tmp_path}/p.pat")
    main(["build", f"{tmp_path}/x.bwt", f"{tmp_path}/index", "--transform", "plain", "--level", "rindex"])
    for way in ("phi", "down", "samples"):
        main(["locate", f"{tmp_path}/index", f"{tmp_path}/p.pat", "--strategy", way, "--out", f"{tmp_path}/{way}"])
        assert sorted((r.pat_id, r.ord, r.pos) for r in spark.read.parquet(f"{tmp_path}/{way}").collect()) == [(0, 0, 6), (0, 1, 8), (0, 2, 3), (0, 3, 0), (1, 0, 9), (1, 1, 4), (1, 2, 1), (2, 0, 5), (2, 1, 2)]
    capsys.readouterr()
    main(["breakdown", f"{tmp_path}/index"])
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == ["table", "rows", "bytes", "bits_per_symbol"] and {x[0] for x in lines[1:]} == {"runs", "c_table"}
