"""The file catalog: what an update reads, file names with odd letters, empty files, failed updates."""

import os
import uuid

from tallybook.operators import filelog
from tallybook.operators.ingest import EMPTY_REASON
from tallybook.session import checkpoint_dir


def write(folder, name, text):
    path = os.path.join(folder.removeprefix("file:"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_only_changed_files_are_read(spark, monkeypatch):
    top = f"{checkpoint_dir(spark)}/filelog-{uuid.uuid4().hex[:8]}"
    folder, catalog = f"{top}/up", f"{top}/catalog"
    write(folder, "a.csv", "x,y\n1,2\n")
    write(folder, "deep/b [1] {2}*?.csv", "x\n\"p\nq\"\n")
    write(folder, "งบ 50%25.csv", "k,,\n")
    write(folder, "blank.csv", "\n\n")
    write(folder, "zero.csv", "")
    write(folder, "not.txt", "x")
    assert filelog.read(spark, catalog).count() == 0
    monkeypatch.setattr(filelog, "FILES_PER_SCAN", 2)
    filelog.update(spark, folder, catalog)
    got = {os.path.basename(r.path): (r.rows, r.columns, r.header, r.status, r.reason, r.read_in) for r in filelog.read(spark, catalog).collect()}
    assert got == {"a.csv": (2, 2, ["x", "y"], "success", None, 1), "b [1] {2}*?.csv": (2, 1, ["x"], "success", None, 1),
                   "งบ 50%25.csv": (1, 1, ["k"], "success", None, 1),
                   "blank.csv": (0, 0, None, "error", EMPTY_REASON, 1), "zero.csv": (0, 0, None, "error", EMPTY_REASON, 1)}

    read = []
    scan = filelog.grid_scan
    monkeypatch.setattr(filelog, "grid_scan", lambda spark, paths: read.extend(paths) or scan(spark, paths))
    assert filelog.update(spark, folder, catalog).isEmpty() and not read and filelog.last_version(spark, catalog) == 1

    write(folder, "a.csv", "x,y\n1,2\n3,4,5\n")
    write(folder, "new.csv", "n\n")
    os.remove(os.path.join(folder.removeprefix("file:"), "blank.csv"))
    assert names(filelog.update(spark, folder, catalog)) == ["a.csv", "new.csv"]
    assert sorted(os.path.basename(p) for p in read) == ["a.csv", "new.csv"]
    got = {os.path.basename(r.path): (r.rows, r.columns, r.read_in) for r in filelog.read(spark, catalog).collect()}
    assert got == {"a.csv": (3, 3, 2), "b [1] {2}*?.csv": (2, 1, 1), "งบ 50%25.csv": (1, 1, 1), "zero.csv": (0, 0, 1), "new.csv": (1, 1, 2)}
    assert filelog.read(spark, catalog, 1).count() == 5

    # a version that was not written whole does not count
    os.makedirs(f"{catalog.removeprefix('file:')}/v3")
    os.remove(os.path.join(folder.removeprefix("file:"), "new.csv"))
    filelog.update(spark, folder, catalog)
    assert filelog.last_version(spark, catalog) == 3 and filelog.read(spark, catalog).count() == 4
