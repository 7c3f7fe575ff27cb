"""F16: files that a task reads whole have a bounded number of elements."""

from millrace.plans import source_queries as Q


def test_xml_files_are_bounded(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, Q.s16(spark, sf).collect()))
    monkeypatch.setattr(Q, "new_path", lambda spark, tag: f"{tmp_path}/{tag}")
    monkeypatch.setattr(Q, "XML_ROWS", 20)
    assert sorted(map(tuple, Q.s16(spark, sf).collect())) == whole
    files = list(tmp_path.glob("drawing/*.xml")) or list(tmp_path.glob("drawing/part-*"))
    assert len(files) == 10 and max(f.read_text().count("<Equipment ") for f in files) == 20
