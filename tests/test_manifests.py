"""Manifests with headers of their own, in folders of their own."""

import csv
import io
import pathlib

import pytest

from codicil.operators import manifest as M
from codicil.sources import files as I
from codicil.sources import manifests as P

FILES = {
    "x y+z%20/downloads.csv": "﻿document_id,saved_filename,status\n1,f1.pdf,ok\n2,f2.pdf\n\n3,\"a \n b.pdf\",ok\n,f4.pdf,ok\n1b, f1.pdf ,again\n",
    "b/downloads.csv": 'saved_filename,date,document_id\r\nf1.pdf,2,9\r\n../x y+z%20/f2.pdf,"say ""hi"", you",7\r\n/abs/./q.pdf,,8\r\n../../../../../../../../../../top.pdf,,10\r\n',
    "c/downloads.csv": "result_page,filename,link_text,url,bytes,status\n3,f1.pdf,x,u,3,ok\n",
    "e/downloads.csv": "",
    "e/f/downloads.csv": "document_id,saved_filename\n",
    "e/other.csv": "document_id,saved_filename\n5,g.pdf\n",
    "g[1]/downloads.csv": "document_id,saved_filename,document_id\n5,g.pdf,6\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "d").mkdir()
    (tmp_path / "d/downloads.csv").write_bytes(b"document_id,saved_filename\n5,g.pdf\n6,\xff\xfe.pdf\n")
    return tmp_path


def by_hand(root):
    """The same with Python's own reader, file by file."""
    found = {}
    for name in sorted(n for n in FILES if n.endswith("downloads.csv")):
        for row in csv.DictReader(io.StringIO(FILES[name].removeprefix("﻿"), newline="")):
            saved, number = (" ".join((row.get(c) or "").split()) for c in ("saved_filename", "document_id"))
            if saved and number:
                found[str((root / name).parent.joinpath(pathlib.Path(saved)).resolve())] = number
    return found


def test_each_file_is_read_by_its_own_header(spark, folder):
    rows = P.scan_manifests(spark, str(folder))
    assert {r.filename: r.document_id for r in P.latest_ids(rows).collect()} == by_hand(folder)
    (gazette,) = rows.filter("manifest LIKE '%/c/%'").collect()
    assert gazette.fields == {"result_page": "3", "filename": "f1.pdf", "link_text": "x", "url": "u", "bytes": "3", "status": "ok"}
    assert rows.filter("manifest LIKE '%/d/%' OR manifest LIKE '%/e/%'").count() == 0
    in_order = [r.fields.get("document_id") for r in rows.filter("manifest LIKE '%z\\%20/%'").orderBy("seq").collect()]
    assert in_order == ["1", "2", "3", None, "1b"]
    other = P.latest_ids(rows, name="filename", document_id="result_page").collect()
    assert [(pathlib.Path(r.filename).parts[-2:], r.document_id) for r in other] == [(("c", "f1.pdf"), "3")]


def test_files_get_the_ids_of_their_own_folders_manifest(spark, folder):
    for name in ("x y+z%20/f1.pdf", "b/f1.pdf", "c/f1.pdf"):
        (folder / name).write_bytes(b"%PDF-")
    files = I.scan_corpus(spark, str(folder)).select(P.plain_path("path").alias("path"))
    got = M.document_ids(files, P.latest_ids(P.scan_manifests(spark, str(folder)))).collect()
    assert {(r.path.removeprefix(f"{folder}/"), r.document_id, r.document_id_source) for r in got} == {("x y+z%20/f1.pdf", "1b", "manifest"), ("b/f1.pdf", "9", "manifest"), ("c/f1.pdf", "f1", "stem")}


def test_no_manifests(spark, tmp_path):
    for root in (tmp_path / "none", tmp_path):
        rows = P.scan_manifests(spark, str(root))
        assert rows.columns == ["manifest", "seq", "fields"] and P.latest_ids(rows).count() == 0


def test_too_many_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "MOST_HEADERS", 2)
    for k in range(3):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "downloads.csv").write_text(f"document_id,x{k}\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        P.scan_manifests(spark, str(tmp_path))
