"""Folder trees: what is walked, what is left out, and how the walk is shared by tasks."""

import os

import pytest

from veritab.sources.tree import TreeSource, _TreeReader, scan_tree


def _make(root):
    for path, content in {
        "a.py": b"print(1)", "B.PY": b"\xef\xbb\xbfx", "c.bin": b"other", "sub/d.py": b"\xff\xfebad", "sub/e.py": b"", "sub/deep/f.py": "gr\u00fcn\r\n".encode(),
        ".git/g.py": b"no", "node_modules/h.py": b"no", "sub/node_modules/x/i.py": b"no", "sub/.j.py": b"no", "big.py": b"x" * 300,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    os.symlink(root / "a.py", root / "link.py")
    os.symlink(root / "sub", root / "linked")
    os.symlink(root, root / "sub" / "loop")


@pytest.mark.parametrize("slices", [1, 2, 3, 50])
def test_walk(spark, tmp_path, slices):
    _make(tmp_path)
    rows = scan_tree(spark, f"file://{tmp_path}", [".py"], max_bytes=256, slices=slices).collect()
    got = {r["path"]: (r["content"], r["n_chars"], r["reason"]) for r in rows}
    assert len(rows) == len(got) and got == {
        "a.py": ("print(1)", 8, None), "B.PY": ("x", 1, None), "sub/e.py": ("", 0, None), "sub/deep/f.py": ("gr\u00fcn\r\n", 6, None),
        "sub/d.py": (None, None, "not readable UTF-8"), "big.py": (None, None, "file exceeds the size limit")}


def test_all_suffixes_and_own_skip_list(spark, tmp_path):
    _make(tmp_path)
    paths = {r["path"] for r in scan_tree(spark, str(tmp_path), skip=["sub"]).select("path").collect()}
    assert paths == {"a.py", "B.PY", "c.bin", "big.py", "node_modules/h.py"}


def test_one_folder_is_shared_and_many_are_dealt(tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.py").write_text(str(i))
    reader = TreeSource({"path": str(tmp_path), "slices": "4"}).reader(None)
    shares = reader.partitions()
    parts = [[p for batch in reader.read(s) for p in batch.column("path").to_pylist()] for s in shares]
    assert len(shares) == 4 and all(len(p) < 40 for p in parts) and sorted(sum(parts, [])) == sorted(f"{i}.py" for i in range(60))
    for i in range(30):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.py").write_text("x")
    assert len(_TreeReader({"path": str(tmp_path), "slices": "8"}).partitions()) == 8


def test_empty_missing_and_remote(spark, tmp_path):
    assert scan_tree(spark, str(tmp_path)).count() == 0
    for path in (str(tmp_path / "none"), "hdfs://x/y"):
        with pytest.raises(Exception, match="folder"):
            scan_tree(spark, path).count()
