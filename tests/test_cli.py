"""Commands over small manifests."""

from __future__ import annotations

import json

from visledger import cli
from visledger.sources import documents


def write(path, boxes, score=None):
    data = {
        "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "Big Dog"}], "images": [{"id": i, "name": f"i{i}", "file_name": f"{i}.png"} for i in range(4)],
        "annotations": [{"id": i + 1, "image_id": i % 4, "category_id": 1 + i % 2, "bbox": b} | ({"score": score - i / 100} if score else {}) for i, b in enumerate(boxes)],
    }
    path.write_text(json.dumps(data))
    return str(path)


def test_commands(spark, tmp_path, capsys):
    boxes = [[10 * i, 5, 8, 8] for i in range(6)]
    a = write(tmp_path / "a.json", boxes)
    b = write(tmp_path / "b.json", boxes, 0.9)
    cli.main(["stats", a], spark)
    assert '"n_anns":6' in capsys.readouterr().out
    cli.main(["eval", a, b], spark)
    scores = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(scores) == 2 and all(abs(s["ap"] - 1) < 1e-9 for s in scores)
    cli.main(["validate", a], spark)
    assert capsys.readouterr().out == ""
    cli.main(["subset", a, "--images", "id < 2", "--categories", "cat", "--dst", str(tmp_path / "s.json")], spark)
    assert documents.read_any(spark, str(tmp_path / "s.json")).images.count() == 1
    cli.main(["union", a, b, "--dst", str(tmp_path / "u")], spark)
    assert documents.read_any(spark, str(tmp_path / "u")).annotations.count() == 12
    cli.main(["split", a, "--folds", "2", "--dst", str(tmp_path / "x"), str(tmp_path / "y")], spark)
    assert sum(documents.read_view(spark, str(tmp_path / n)).images.count() for n in "xy") == 4
    cli.main(["modify_categories", a, "--rename", '{"cat": "lion"}', "--start", "5", "--dst", str(tmp_path / "m.json")], spark)
    assert {r["name"] for r in documents.read_any(spark, str(tmp_path / "m.json")).categories.collect()} == {"lion", "Big Dog"}
    cli.main(["move_assets", a, "--moves", "x=y", "--dst", str(tmp_path / "z.zip")], spark)
    assert documents.read_any(spark, str(tmp_path / "z.zip")).images.count() == 4


def test_further_commands(spark, tmp_path, capsys):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "0.png").write_bytes(b"x")
    (tmp_path / "old" / "stray.png").write_bytes(b"x")
    a = write(tmp_path / "old" / "a.json", [[1, 2, 3, 4]])
    cli.main(["find_unregistered_images", a], spark)
    found = {json.loads(x)["path"].rpartition("/")[2] for x in capsys.readouterr().out.splitlines()}
    assert "stray.png" in found and "0.png" not in found
    cli.main(["plot_stats", a, "--dst", str(tmp_path / "tables")], spark)
    assert spark.read.parquet(str(tmp_path / "tables" / "annotations")).count() == 1 and spark.read.parquet(str(tmp_path / "tables" / "images")).count() == 4
    (tmp_path / "new").mkdir()
    moved = str(tmp_path / "new" / "b.json")
    cli.main(["move", a, "--dst", moved], spark)
    m = documents.read_any(spark, moved)
    assert not (tmp_path / "old" / "a.json").exists() and m.images.where("id = 0").first()["file_name"] == str(tmp_path / "old" / "0.png")
    cli.main(["toydata", "shapes4", "--dst", str(tmp_path / "toy.json")], spark)
    assert documents.read_any(spark, str(tmp_path / "toy.json")).images.count() == 4


def test_a_manifest_of_confusions(spark, tmp_path):
    from visledger.operators import match

    a = documents.read_any(spark, write(tmp_path / "a.json", [[0, 0, 8, 8], [10, 0, 8, 8], [0, 0, 8, 8]]))
    b = documents.read_any(spark, write(tmp_path / "b.json", [[0, 0, 8, 8], [50, 0, 8, 8]], 0.9))
    m = match.confusion_manifest(a, b, match.confusion_vectors(match.detections(a), match.detections(b)))
    got = sorted((r["id"], json.loads(r["extra"])["side"], json.loads(r["extra"])["role"]) for r in m.annotations.collect())
    assert got == [(1, "true", "true positive"), (2, "true", "false negative"), (3, "true", "false negative"), (5, "pred", "true positive"), (6, "pred", "false positive")]
