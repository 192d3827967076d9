"""Word files taken as they come, edited ones again, unchanged ones not."""

import datetime
import os
import time

from pyspark.sql import functions as F

from tidemark.operators import boundary, store
from tidemark.sources import docx
from tidemark.streaming import ingest


def test_an_edited_file_is_taken_again_and_an_unchanged_one_is_not(spark, tmp_path):
    folder = tmp_path / "in" / "דנה לוי"
    folder.mkdir(parents=True)
    one, two, three = (folder / f"תוכנית טיפול {i} דנה לוי.docx" for i in (1, 2, 3))
    day = lambda path, d: docx.write(str(path), [(f"{d}/3/2025", False), (f"note {d}", False)])
    day(one, 1)
    day(two, 2)
    now = lambda: F.lit(datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    root, how = f"file://{tmp_path}/db", {"model": boundary.gazetteer(["zzz"]), "embedder": boundary.hashing_embedder(4)}
    go = lambda: [sorted((os.path.basename(r["path"]), r["status"]) for r in rows.collect()) for rows in ingest.take_files(spark, [f"file://{tmp_path}/in"], root, f"{tmp_path}/c", now, **how)]
    assert go() == [[(one.name, "ok"), (two.name, "ok")]]
    assert go() == []
    time.sleep(1.1)
    day(one, 5)
    os.utime(two)  # touched, not changed
    day(three, 3)
    assert go() == [[(three.name, "ok")], [(one.name, "ok"), (two.name, "skipped")]]
    db = store.Database(spark, root)
    assert sorted(r["text"] for r in db.read("session").collect()) == ["note 2", "note 3", "note 5"]
    assert sorted(str(r["session_date"]) for r in db.read("vector").collect()) == ["2025-03-02", "2025-03-03", "2025-03-05"]
