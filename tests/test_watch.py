"""A watched folder with real files over three scans, and scans that are run again."""

import datetime
import os
import time

from fernloom.streaming.watch import FolderWatch, listed


def test_real_files(spark, tmp_path):
    folder, watch = tmp_path / "notes", FolderWatch(spark, str(tmp_path / "state"))
    (folder / ".git").mkdir(parents=True)
    (folder / "deep").mkdir()
    old = time.time() - 100

    def put(name, text, at=old):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def scan(number, at):
        rows = watch.scan(listed(spark, str(folder)), datetime.datetime.fromtimestamp(at, datetime.timezone.utc), number).collect()
        return sorted((os.path.basename(r["path"]), r["event"], r["size"]) for r in rows)

    for name in ("a.md", "deep/b.MD", "c.txt", ".git/d.md", ".e.md", "f.md"):
        put(name, "one")
    put("g.md", "busy", old + 99.5)
    assert scan(0, old + 100) == [("a.md", "created", 3), ("b.MD", "created", 3), ("f.md", "created", 3)]
    put("a.md", "longer", old + 150)
    (folder / "f.md").unlink()
    put("h.md", "new", old + 150)
    put("deep/b.MD", "two", old + 199)  # still being written
    want = [("a.md", "modified", 6), ("f.md", "deleted", 3), ("g.md", "created", 4), ("h.md", "created", 3)]
    assert scan(1, old + 200) == want == scan(1, old + 200)
    (folder / "g.md").unlink()
    assert scan(2, old + 300) == [("b.MD", "modified", 3), ("g.md", "deleted", 4)]
    assert scan(3, old + 400) == []
    assert sorted(r["event"] for r in watch.events(1).collect()) == ["created", "created", "deleted", "modified"]


def test_odd_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("/a.md", None, 3), ("/a.md", at - datetime.timedelta(days=1), 5), (None, at, 1), ("/b.md", None, None)]
    files = spark.createDataFrame(rows, "path string, modified timestamp, size long")
    quiet = FolderWatch(spark, str(tmp_path / "x"), initial=False)
    assert quiet.scan(files, at, 0).collect() == [] and quiet.scan(files, at, 1).collect() == []
    assert sorted((r["path"], r["event"], r["size"]) for r in quiet.scan(files.limit(0), at, 2).collect()) == [("/a.md", "deleted", 5), ("/b.md", "deleted", None)]
    assert quiet.scan(files.limit(0), at, 3).count() == 0
