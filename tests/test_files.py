"""Files behind a manifest."""

from __future__ import annotations

from visledger.manifest import from_rows
from visledger.operators import files


def test_files_on_disk(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A") + b"body" + bytes.fromhex("49454E44AE426082")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(png[:-3])
    (tmp_path / "notes.txt").write_bytes(b"x")
    there = files.present(spark, str(tmp_path))
    assert {tuple(r) for r in there.collect()} == {("sub/a.png", len(png)), ("b.png", len(png) - 3), ("notes.txt", 1)}
    m = from_rows(spark, {"images": [{"id": 1, "file_name": "sub/a.png"}, {"id": 2, "file_name": "c.png"}, {"id": 3, "name": "n", "assets": [{"file_name": "b.png"}, {"file_name": "d.png"}]}],
                          "annotations": [{"id": 1, "image_id": 2}, {"id": 2, "image_id": 3}]})
    assert {r["file_name"] for r in files.missing(m, there).collect()} == {"c.png", "d.png"}
    assert files.disk_usage(m, there).first().asDict() == {"files": 2, "bytes": 2 * len(png) - 3, "missing": 2}
    assert [r["file_name"] for r in files.damaged(spark, str(tmp_path)).collect()] == ["b.png"]
    out = files.drop_files(m, files.missing(m, there))
    assert sorted(r["id"] for r in out.images.collect()) == [1, 3] and [r["image_id"] for r in out.annotations.collect()] == [3]
    assert len(out.images.where("id = 3").first()["assets"]) == 1


def test_documents_with_numbers_that_json_lacks(spark, tmp_path):
    from visledger.sources import documents

    path = tmp_path / "m.json"
    path.write_text('{"info": {"a": "]"}, "images": [{"id": 1, "name": "NaN, \\"Infinity\\" ]}", "file_name": "x"}], "annotations": [{"id": 1, "image_id": 1, "score": NaN, "note": -Infinity},\n {"id": 2, "image_id": 1, "score": 0.5, "segmentation": [[1, 2, 3, 4, 5, 6]]}], "videos": []}')
    for read in (lambda p: documents.read_documents(spark, p), lambda p: documents.read_large_documents(spark, [p])):
        m = read(str(path))
        for _ in range(2):
            assert m.images.first()["name"] == 'NaN, "Infinity" ]}'
            scores = {r["id"]: r["score"] for r in m.annotations.collect()}
            assert scores[1] != scores[1] and scores[2] == 0.5
            assert '"-Infinity"' in m.annotations.where("id = 1").first()["extra"]
            assert m.annotations.where("id = 2").first()["segmentation"].replace(" ", "") == "[[1,2,3,4,5,6]]"
            again = tmp_path / "again.json"
            documents.write_document(m, str(again))
            documents.write_document(m, str(again))
            m = read(str(again))
    assert not list(tmp_path.glob("*.tmp"))


def test_documents_that_cannot_be_read_are_errors(spark, tmp_path):
    import pytest

    from visledger.sources import documents

    for i, text in enumerate(('{"images": [{"id": 1}', "[1]")):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="not a JSON object"):
            documents.read_documents(spark, str(path)).images.count()
    with pytest.raises(Exception, match="ends within"):
        documents.read_large_documents(spark, [str(tmp_path / "0.json")])


def test_elements_of_a_document_in_pieces():
    import json

    from visledger.sources.documents import elements

    doc = {"info": {"x": [1, {"y": 2}]}, "images": [{"id": i, "name": 'a"\\]},{[' * (i % 3)} for i in range(20)], "n": 3, "s": "t,", "videos": [], "annotations": [[1, [2]], 5, "a,b", None]}
    text = json.dumps(doc, indent=1)
    want = [(k, x) for k in ("images", "annotations") for x in doc[k]]
    for size in (1, 3, 7, 64, 10_000):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert [(k, json.loads(x)) for k, x in elements(pieces)] == want


def test_elements_of_a_document_in_ranges():
    """Every range of a document gives the elements that begin in it, whatever it cuts."""
    import io
    import json

    from visledger.sources import documents as D

    doc = {"info": {"x": [1, {"y": 2}]}, "images": [{"id": i, "name": 'a"\\]},{[é\\\\"' * (i % 3)} for i in range(12)], "n": 3, "s": "t,", "e": [], "videos": [], "annotations": [[1, [2]], 5, "a,b", None]}
    for indent in (None, 1):
        text = json.dumps(doc, indent=indent, ensure_ascii=False).encode()
        want = [(k, x) for k in ("images", "annotations") for x in doc[k]]
        lists, quoted, depth, states = [], False, 0, []
        for at in range(len(text)):
            states.append((quoted, depth))
            (_, places, kind, quoted, depth), = D._bounds([text[at : at + 1]], quoted, D._escaped(io.BytesIO(text), at), depth)
            if len(places) and kind[0] == D._OPEN and text[at] == 91:
                lists.append([at, None, json.loads(D._WORD.findall(text[:at].decode())[-1])])
            elif len(places) and kind[0] == D._CLOSE and lists:
                lists[-1][1] = lists[-1][1] or at
        for size in (1, 5, 17, 64, 5000):
            got = []
            for at in range(0, len(text), size):
                inside = next((n for a, b, n in lists if a < at <= b), None)
                later = {a - at: n for a, _, n in lists}
                chunks = [text[i : i + 7] for i in range(at, len(text), 7)]
                for name, texts in D.element_arrays(chunks, states[at][0], D._escaped(io.BytesIO(text), at), states[at][1], inside, later, size):
                    got += [(name, json.loads(t)) for t in texts.to_pylist()]
            assert got == want, size


def test_large_documents_are_read_in_pieces_by_many_tasks(spark, tmp_path, monkeypatch):
    import json

    import pytest

    from visledger.sources import documents as D

    images = [{"id": i, "name": f'im "{i}" ]}},' + "\\" * (i % 4), "width": 5, "more": {"a": [i]}} for i in range(3000)]
    path = tmp_path / "a b%20.json"
    path.write_text(json.dumps({"info": {"images": [1]}, "videos": [], "images": images, "annotations": [{"id": i, "image_id": i} for i in range(500)]}))
    monkeypatch.setattr(D, "PIECE", 10_000)
    monkeypatch.setattr(D, "WHOLE", 1000)  # so small a bound stands for a document that no row can hold
    m = D.read_documents(spark, str(path))
    assert sorted((r["id"], r["name"]) for r in m.images.select("id", "name").collect()) == [(i["id"], i["name"]) for i in images]
    assert m.annotations.count() == 500 and m.videos.count() == 0 and json.loads(m.images.where("id = 7").first()["extra"]) == {"more": {"a": [7]}}
    assert D.read_large_documents(spark, [str(path)] * 2).images.count() == 6000
    (tmp_path / "list.json").write_text("[" + "1," * 2000 + "1]")
    with pytest.raises(Exception, match="not a JSON object"):
        D.read_documents(spark, str(tmp_path / "list.json"))
    (tmp_path / "cut.json").write_text(path.read_text()[:-3000])
    with pytest.raises(Exception, match="ends within"):
        D.read_documents(spark, str(tmp_path / "cut.json"))
