"""Uploads that know their files, and that share a folder with other uploads."""

import datetime as dt

import pytest

from duebook.plans import upload
from duebook.plans.followup import Store
from duebook.sources import fingerprints
from duebook.sources.claims import Claims

AS_OF, NOW = dt.date(2026, 5, 14), dt.datetime(2026, 5, 14, 13)
HEAD = "client_name,recipient_email,invoice_number,amount,due_date\n"


def put(folder, name, number):
    (folder / name).write_text(f"{HEAD}C,c@b.co,{number},5.00,2026-05-09\n")


def uploaded(spark, root, folder, now=NOW):
    rows = upload.run_uploads(Store(spark, root, queue_parts=2), str(folder), AS_OF, now, date_mode="iso").collect()
    return {r.file_path.rsplit("/", 1)[1]: (r.decision, r.job_id) for r in rows}


def statuses(spark, root):
    return {r.id: r.status for r in upload.ledger(Store(spark, root)).collect()}


def test_only_new_files_are_read_and_dead_jobs_are_resumed(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "a.csv", "A")
    put(folder, "b.csv", "B")
    put(folder, "copy.csv", "B")
    hashed, parsed = [], []
    hashes, parses = fingerprints.file_fingerprints, upload.read_mixed_csv
    monkeypatch.setattr(fingerprints, "file_fingerprints", lambda s, paths: hashed.append(sorted(p[-5] for p in paths)) or hashes(s, paths))
    monkeypatch.setattr(upload, "read_mixed_csv", lambda s, paths: parsed.append(sorted(p[-5] for p in paths)) or parses(s, paths))
    assert uploaded(spark, root, folder) == {"a.csv": ("new", 1), "b.csv": ("new", 2), "copy.csv": ("in_progress", None)}
    put(folder, "c.csv", "CC")
    monkeypatch.setattr(upload, "run_follow_up", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # the driver dies: nothing is recorded
        uploaded(spark, root, folder)
    monkeypatch.undo()
    assert statuses(spark, root) == {1: "completed", 2: "completed", 3: "running"}
    assert hashed == [["a", "b", "y"], ["c"]] and parsed == [["a", "b"], ["c"]]
    assert uploaded(spark, root, folder, NOW + dt.timedelta(hours=1))["c.csv"] == ("in_progress", None)
    later = uploaded(spark, root, folder, NOW + dt.timedelta(hours=7))
    assert later["c.csv"] == ("resumed", 3) and later["a.csv"][0] == "cached"
    assert statuses(spark, root) == {1: "completed", 2: "completed", 3: "completed"}


def test_claims_are_given_to_one(spark, tmp_path):
    one, two = (Claims(spark, str(tmp_path / "c"), dt.timedelta(hours=1)) for _ in range(2))
    assert one.take("h", "one", NOW) and not two.take("h", "two", NOW)
    assert two.take("h", "two", NOW + dt.timedelta(hours=1)) and not one.take("h", "one", NOW + dt.timedelta(hours=1))
    two.release("h")
    assert one.take("h", "one", NOW)
    assert [one.next_number(), two.next_number(), one.next_number(7), two.next_number()] == [1, 2, 8, 9]
