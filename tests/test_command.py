from quarry.__main__ import main


def test_exact_and_ranked_commands(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("retry the request\nafter a timeout\n")
    (tmp_path / "b.py").write_text("def retry(x):\n    return x\n")
    root = str(tmp_path)
    assert main(["-e", "retry", root], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["a.txt:1:retry the request", "b.py:1:def retry(x):"]
    assert main(["-e", "RETRY", "-i", "-c", "-g", "*.py", root], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["b.py:1"]
    assert main(["-e", "timeout", "-C", "1", root], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["a.txt-1-retry the request", "a.txt:2:after a timeout"]
    assert main(["-e", "nothing like it", root], spark) == 1
    assert main(["timeout", root, "--mode", "bm25", "-l"], spark) == 0
    assert "a.txt" in capsys.readouterr().out
    assert main(["", root], spark) == 2
    assert main(["x", str(tmp_path / "gone")], spark) == 2
