"""Demo manifests, cached views and reroots."""

from __future__ import annotations

import os

import pytest

from visledger.operators import check, edit
from visledger.sources import documents
from visledger.sources.demo import demo


def test_demo_manifests(spark):
    m = demo(spark, "vidshapes3-frames4-tracks2")
    assert [m.table(t).count() for t in ("videos", "images", "tracks", "annotations")] == [3, 12, 6, 24]
    assert m.annotations.select("id").distinct().count() == 24 and check.validate(m).where("level = 'error'").count() == 0
    again = demo(spark, "vidshapes3-frames4-tracks2").annotations
    assert sorted(map(str, again.collect())) == sorted(map(str, m.annotations.collect()))
    s = demo(spark, "shapes8")
    assert s.images.count() == 8 and 8 <= s.annotations.count() <= 40 and s.annotations.select("id").distinct().count() == s.annotations.count()
    with pytest.raises(ValueError):
        demo(spark, "circles3")


def test_cached_view_follows_its_document(spark, tmp_path):
    path, folder = str(tmp_path / "m.json"), str(tmp_path / "view")
    documents.write_document(demo(spark, "shapes3"), path)
    assert documents.cached_view(spark, path, folder).images.count() == 3
    stamp = os.stat(f"{folder}/images").st_ino
    assert documents.cached_view(spark, path, folder).images.count() == 3 and os.stat(f"{folder}/images").st_ino == stamp
    documents.write_document(demo(spark, "shapes5"), path)
    assert documents.cached_view(spark, path, folder).images.count() == 5
    documents.drop_view(spark, folder)
    assert not os.path.exists(folder)


def test_reroot_is_found(spark):
    lost = spark.createDataFrame([(f"old/place/{k}/f{i}.png",) for k in "ab" for i in range(5)] + [("ok.png",), (None,)], "file_name string")
    there = spark.createDataFrame([(f"new/{k}/f{i}.png",) for k in "ab" for i in range(5)] + [("ok.png",), ("x/f1.png",)], "file_name string")
    best = edit.find_reroot(lost, there).first()
    assert tuple(best) == ("old/place", "new", 10, 10)
    assert edit.find_reroot(there, there).count() == 0
