"""Documents, views, edits and set operations on small manifests."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from visledger.manifest import Manifest, from_rows
from visledger.operators import check, edit, select, setops, stats
from visledger.sources import documents, formats

PHOTOS = {
    "info": {"about": "three photos"},
    "categories": [{"id": i + 1, "name": n} for i, n in enumerate("astronaut rocket helmet mouth star astronomer astroturf human".split())],
    "images": [{"id": i, "file_name": f"img{i}.png", "width": 100 * i, "height": 50, "mood": "bright"} for i in (1, 2, 3)],
    "annotations": [
        {"id": 1, "image_id": 1, "category_id": 1, "bbox": [10, 10, 360, 490], "keypoints": [1, 2, 2, 3, 4, 1], "segmentation": [[0, 0, 1, 1, 2, 0]]},
        {"id": 2, "image_id": 1, "category_id": 2, "bbox": [350, 5, 130, 290]}, {"id": 3, "image_id": 1, "category_id": 3, "line": [1, 2]},
        {"id": 4, "image_id": 1, "category_id": 4, "keypoints": [{"xy": [1, 2], "visible": 1, "keypoint_category_id": 7}]},
        *[{"id": i, "image_id": 1, "category_id": 5, "keypoints": {"x": [i], "y": [0], "keypoint_category_id": [2]}} for i in range(5, 10)],
        {"id": 10, "image_id": 2, "category_id": 6, "bbox": [37, 6, 230, 240]}, {"id": 11, "image_id": 2, "category_id": 4, "bbox": [156, 130, 45, 18]},
    ],
}


def cats(spark, *triples, **more):
    return from_rows(spark, {"categories": [{"id": i, "name": n, **x} for i, n, x in triples], **more})


def table(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_basic_counts_and_frequency(spark):
    m = from_rows(spark, PHOTOS)
    assert stats.basic_stats(m).first().asDict() == {"n_anns": 11, "n_imgs": 3, "n_videos": 0, "n_cats": 8, "n_tracks": 0}
    freq = dict(table(stats.category_frequency(m), "category", "n"))
    assert freq == {"astroturf": 0, "human": 0, "astronaut": 1, "astronomer": 1, "helmet": 1, "rocket": 1, "mouth": 2, "star": 5}
    assert table(select.annotations_per_image(m), "image_id", "n") == [(1, 9), (2, 2), (3, 0)]
    kinds = {r[0]: {} for r in table(stats.type_frequency(m, ("bbox", "keypoints")), "category")}
    for c, t, n in table(stats.type_frequency(m, ("bbox", "keypoints")), "category", "type", "n"):
        kinds[c][t] = n
    assert kinds["astronaut"] == {"bbox+keypoints": 1} and kinds["star"] == {"keypoints": 5} and kinds["mouth"] == {"bbox": 1, "keypoints": 1}


def test_null_categories(spark):
    m = from_rows(spark, {"images": [{"id": 1, "name": "a"}], "annotations": [{"id": 1, "image_id": 1}, {"id": 2, "image_id": 1}]})
    u = setops.union([m, m])
    assert table(stats.category_frequency(u), "category", "n") == [(None, 4)]


def test_unknown_attributes_survive(spark, tmp_path):
    m = from_rows(spark, PHOTOS)
    a = setops.subset(m, m.images.where("id = 1").select("id")).annotations
    assert json.loads(a.where("id = 3").first()["extra"]) == {"line": [1, 2]}
    assert select.lookup(m.images, "mood").first()["mood"] == "bright"
    path = str(tmp_path / "m.json")
    documents.write_document(m, path)
    back = documents.read_any(spark, path)
    assert table(back.annotations, "id", "category_id", "bbox") == table(m.annotations, "id", "category_id", "bbox")
    assert json.loads(back.annotations.where("id = 3").first()["extra"]) == {"line": [1, 2]}


@pytest.mark.parametrize("name", ["m.zip", "m.json"])
def test_read_document_forms(spark, tmp_path, name):
    (tmp_path / "data.json").write_text(json.dumps(PHOTOS))
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("data.json", json.dumps(PHOTOS))
    (tmp_path / "m.json").write_text(json.dumps(PHOTOS))
    m = documents.read_any(spark, str(tmp_path / name))
    assert m.images.count() == 3 and m.annotations.count() == 11
    kp = {r["id"]: r["keypoints"] for r in m.annotations.select("id", "keypoints").collect()}
    assert [(k["x"], k["y"], k["visible"]) for k in kp[1]] == [(1, 2, 2), (3, 4, 1)] and kp[2] is None
    assert kp[4][0]["keypoint_category_id"] == 7
    documents.write_view(m, str(tmp_path / "view"))
    assert documents.read_any(spark, str(tmp_path / "view")).annotations.count() == 11


def test_rename_policies(spark):
    rows = [(1, "a", {"supercategory": "x"}), (2, "b", {"supercategory": "y"}), (3, "c", {"supercategory": "z"})]
    an = [{"id": i, "image_id": 1, "category_id": i} for i in (1, 2, 3)]
    m = cats(spark, *rows, annotations=an)
    for merge, want in (("ignore", [(1, "e", None), (2, "d", None)]), ("update", [(1, "e", "z"), (2, "d", "y")])):
        out = edit.rename_categories(m, {"a": "e", "c": "e", "b": "d"}, merge)
        assert table(out.categories, "id", "name", "supercategory") == want
        assert table(out.annotations, "id", "category_id") == [(1, 1), (2, 2), (3, 1)]
    with pytest.raises(KeyError):
        edit.rename_categories(m, {"nothing": "x"})


def test_renumber_categories(spark):
    m = from_rows(spark, PHOTOS)
    assert [n for _, n in table(edit.renumber_categories(m, 1).categories, "id", "name")] == sorted(c["name"] for c in PHOTOS["categories"])
    first = dict(map(reversed, table(edit.renumber_categories(m, 2, ["human"]).categories, "id", "name")))
    assert first["human"] == 2 and min(first.values()) == 2


def test_union_of_same_and_conflicting_categories(spark):
    same = cats(spark, *[(i, f"cat{i}", {}) for i in range(6)])
    assert table(setops.union([same, same]).categories, "id", "name") == [(i, f"cat{i}") for i in range(6)]
    a = cats(spark, (0, "cat1", {}), (3, "cat2", {}), (2, "cat5", {}))
    b = cats(spark, (2, "cat3", {}), (1, "cat4", {}), (3, "cat5", {}))
    got = {n: i for i, n in table(setops.union([a, b]).categories, "id", "name")}
    assert got == {"cat1": 0, "cat2": 3, "cat5": 2, "cat3": 4, "cat4": 1}


def test_union_of_keypoint_categories(spark):
    rows = [(8, "left_hand", 6), (6, "right_hand", 8), (7, "left_foot", 5), (5, "right_foot", 7), (3, "head", None)]
    m = from_rows(spark, {"keypoint_categories": [{"id": i, "name": n, "reflection_id": r} for i, n, r in rows]})
    assert table(setops.union([m, m]).keypoint_categories, "id", "name", "reflection_id") == sorted(rows)


def tracked(spark, names=True):
    data = {"images": [{"id": 1, "name": "i"}], "annotations": [{"id": i, "image_id": 1, "track_id": 0 if not names and i < 3 else 1 if i < 3 else 2 if names else 1} for i in (1, 2, 3, 4)]}
    if names:
        data["tracks"] = [{"id": 1, "name": "track_001"}, {"id": 2, "name": "track_002"}]
    return from_rows(spark, data)


def test_union_of_tracks(spark):
    m = tracked(spark)
    apart = setops.union([m, m])
    assert sorted(n for (n,) in table(apart.tracks, "name")) == ["track_001", "track_001_v001", "track_002", "track_002_v001"] or len(table(apart.tracks, "name")) == 4
    assert apart.annotations.select("track_id").distinct().count() == 4
    one = setops.union([m, m], disjoint_tracks=False)
    assert [n for (n,) in table(one.tracks, "name")] == ["track_001", "track_002"]
    assert [t for _, t in table(one.annotations, "id", "track_id")] == ["1", "1", "2", "2"] * 2
    loose = tracked(spark, names=False)
    assert setops.union([loose, loose]).annotations.select("track_id").distinct().count() == 4
    assert setops.union([loose, loose], disjoint_tracks=False).annotations.select("track_id").distinct().count() == 2


def test_union_makes_the_columns_that_are_asked_for(spark):
    """Classes of a union are told without looking up tracks or images, which gives what the whole table has."""
    m = tracked(spark)
    for disjoint in (True, False):
        u = setops.union([m, m], disjoint)
        parts = {c: sorted(map(str, table(u.only("annotations", c), c))) for c in ("category_id", "track_id", "image_id", "id")}
        few = setops.union([m, m], disjoint)
        few.only("annotations", "category_id").collect()
        few.only("images", "id").collect()
        assert not {"annotations", "images", "tracks"} & set(few.__dict__)
        assert sorted(map(str, table(few.only("images", "id"), "id"))) == sorted(map(str, table(few.images, "id")))
        assert parts == {c: sorted(map(str, table(u.annotations, c))) for c in parts}
        assert sorted(map(str, table(u.only("annotations", "id", "track_id"), "id", "track_id"))) == sorted(map(str, table(u.annotations, "id", "track_id")))


def test_union_of_names_with_versions(spark):
    a = from_rows(spark, {"videos": [{"id": 1, "name": "v"}, {"id": 2, "name": "v_v001"}]})
    names = [n for (n,) in table(setops.union([a, a, a]).videos, "name")]
    assert len(names) == len(set(names)) == 6 and {"v", "v_v001"} <= set(names)


def test_removals_cascade(spark):
    m = from_rows(spark, PHOTOS | {"videos": [{"id": 9, "name": "v"}], "images": [{"id": 1, "name": "a", "video_id": 9}, {"id": 2, "name": "b"}]})
    out = edit.remove_videos(m, spark.createDataFrame([(9,)], "id bigint"))
    assert (out.videos.count(), out.images.count(), out.annotations.count()) == (0, 1, 2)
    with pytest.raises(ValueError):
        edit.append(m, "images", spark.createDataFrame([(1, "z")], "id bigint, name string"))


def test_validation_finds_faults(spark):
    data = {
        "categories": [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}], "images": [
            {"id": 1, "name": "x", "assets": [{"file_name": "p", "channels": "red|green|blue"}, {"file_name": "q", "channels": "B0|B1|green|B3"}]},
            {"id": 2, "file_name": "../out.png"}, {"id": 3, "assets": [{"file_name": "r", "channels": "B0"}]},
        ], "annotations": [{"id": 1, "image_id": 77, "category_id": 5, "track_id": 3}],
    }
    got = {(r["level"], r["what"], r["value"]) for r in check.validate(from_rows(spark, data)).collect()}
    assert {("error", "categories.id is not unique", "1"), ("error", "annotations.image_id points nowhere", "77"), ("error", "annotations.category_id points nowhere", "5"),
            ("warning", "annotations.track_id points nowhere", "3"), ("error", "a channel twice", "1:green"), ("warning", "path outside of the folder", "../out.png"),
            ("error", "image without name", "3")} == got


def test_frames_stand_in_order(spark):
    im = [{"id": i, "name": f"f{i}", "video_id": 1 + i % 2, "frame_index": (i * 7) % 10} for i in range(10)]
    m = from_rows(spark, {"videos": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3, "name": "c"}], "images": im})
    got = {r["video_id"]: r["image_ids"] for r in select.frames(m).collect()}
    assert got[3] == [] and all(got[v] == [i["id"] for i in sorted(im, key=lambda x: x["frame_index"]) if i["video_id"] == v] for v in (1, 2))


def test_assets(spark):
    im = {"id": 1, "name": "x", "assets": [{"file_name": "small", "channels": "B1", "width": 2, "height": 2}, {"file_name": "large", "channels": "rgb", "width": 9, "height": 9}]}
    m = from_rows(spark, {"images": [im]})
    assert select.primary_asset(m.images).first()["file_name"] == "large"
    assert select.asset_with(m.images, ["green"]).first()["file_name"] == "large"
    assert select.assets(m.images).count() == 2


def test_folds_do_not_part_groups(spark):
    from visledger.sources import star

    m = star.manifest(spark, "/root/testdata/sf0.001")
    rest, part = setops.split(m, folds=4, fold=1)
    assert rest.images.count() + part.images.count() == m.images.count()
    assert rest.images.select("video_id").distinct().join(part.images.select("video_id").distinct(), "video_id").count() == 0
    sizes = [r["n"] for r in setops.group_folds(m, 4).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_kw18_text(spark, tmp_path):
    line = "7 2 3 1 2 0 0 11 12 10 10 20 30 200 0 0 0 5.5 0.75 4 -1"
    (tmp_path / "t.kw18").write_text("# header\n" + line + "\n\n" + line.replace("7 2 3", "7 2 4", 1) + "\n")
    m = formats.from_kw18(formats.read_kw18(spark, str(tmp_path / "t.kw18")))
    assert (m.images.count(), m.annotations.count(), m.tracks.count()) == (2, 2, 1)
    a = m.annotations.orderBy("id").first()
    assert (a["bbox"]["w"], a["bbox"]["h"], a["score"], a["category_id"]) == (10, 20, 0.75, 4)
    assert m.categories.first()["name"] == "class_4"


def test_kw18_of_null_tracks_and_some_columns(spark):
    """Null tracks get numbers behind the others by id, the others stay out of that order; annotations are counted without numbers."""
    rows = [{"id": i, "image_id": i, "bbox": [i, 0, 2, 2], "track_id": None if i % 3 == 0 else 10 + i % 3} for i in range(9)]
    m = from_rows(spark, {"images": [{"id": i, "frame_index": i} for i in range(9)], "annotations": rows})
    got = formats.to_kw18(m)
    assert sorted((r["frame_number"], r["track_id"], r["track_length"]) for r in got.collect()) == [(float(i), 13.0 + i // 3 if i % 3 == 0 else 10.0 + i % 3, 1.0 if i % 3 == 0 else 3.0) for i in range(9)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [" in line and "row_number" in line] == []
    back = formats.from_kw18(got)
    assert back.only("annotations", "track_id").count() == 9 and "annotations" not in back.__dict__ and "images" not in back.__dict__
    assert sorted(r[0] for r in back.annotations.select("id").collect()) == list(range(1, 10)) and back.annotations.where("image_id is null").isEmpty()
    assert back.tracks.count() == 5 and back.images.count() == 9


def test_labelme_and_voc(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"imagePath": "a.png", "imageWidth": 8, "imageHeight": 9, "shapes": [{"label": "cat", "points": [[1, 2], [5, 2], [5, 8]], "shape_type": "polygon"}]}))
    r = formats.read_labelme(spark, str(tmp_path / "a.json")).first()
    assert (r["label"], tuple(r["bbox"])) == ("cat", (1.0, 2.0, 4.0, 6.0))
    box = "<bndbox><xmin>11</xmin><ymin>21</ymin><xmax>31</xmax><ymax>51</ymax></bndbox>"
    objects = f"<object><name>dog</name><difficult>1</difficult>{box}</object><object><name>cow</name>{box}</object>"
    (tmp_path / "b.xml").write_text(f"<annotation><filename>b.jpg</filename><size><width>100</width><height>90</height></size>{objects}</annotation>")
    rows = formats.read_voc(spark, str(tmp_path / "b.xml"))
    assert {(r["label"], r["weight"], tuple(r["bbox"])) for r in rows.collect()} == {("dog", 0.0, (10.0, 20.0, 20.0, 30.0)), ("cow", 1.0, (10.0, 20.0, 20.0, 30.0))}
    m = formats.from_labels(rows)
    assert (m.images.count(), m.categories.count(), m.annotations.count()) == (1, 2, 2)


def test_class_folders_and_roots(spark):
    files = spark.createDataFrame([("r/cat/1.png",), ("r/cat/2.png",), ("r/dog/3.png",)], "file_name string")
    assert dict(table(stats.category_frequency(documents.from_class_folders(spark, files)), "category", "n")) == {"cat": 2, "dog": 1}
    assert setops.common_root(["/a/b/c", "/a/b", "/a/bd"]) == "/a"
    assert isinstance(documents.read_any(spark, {"images": []}), Manifest)


def test_lines_round_trip(spark, tmp_path):
    m = from_rows(spark, PHOTOS | {"images": [*PHOTOS["images"], {"id": 4, "name": "two\nlines", "timestamp": "2020-01-02T03:04:05.123456"}]})
    for name, df in m.tables().items():
        df = df.repartition(3)
        documents.write_lines(df, name, str(tmp_path / name))
        back = documents.read_lines(spark, name, str(tmp_path / name))
        shown = [c for c in df.columns if c != "extra"]
        assert table(back, *shown) == table(df, *shown), name
        extra = lambda d: sorted((str(r["id"]), json.loads(r["extra"] or "{}")) for r in d.select("id", "extra").collect())
        assert [(i, {k: v for k, v in x.items() if k != "timestamp"}) for i, x in extra(df)] == extra(back), name
    assert len(list((tmp_path / "annotations").glob("part-*"))) == 3  # no task holds the whole table


def test_row_numbers_over_ranges(spark):
    from visledger.operators.order import number_rows

    rows = spark.range(1000).select("id", (F.col("id") * 37 % 10).alias("k"))
    got = table(number_rows(rows, [F.desc("k"), "id"], "nth"), "nth", "id", "k")
    want = sorted(((i, i * 37 % 10) for i in range(1000)), key=lambda r: (-r[1], r[0]))
    assert got == sorted(((n, *r) for n, r in enumerate(want, 1)), key=repr)


def test_name_versions_of_long_ids(spark):
    from visledger.plans import more

    got = {r["id"]: r["number"] for r in more.QUERIES["fn_name_versions"](spark, "/root/testdata/sf0.1").where("id >= 1000").collect()}
    assert got and all(n == (None if i % 2 else i) for i, n in got.items())
