"""Files of networks."""

from xml.etree import ElementTree

from shuttleframe.plans import file_queries


def test_a_large_document_is_written_and_read_in_pieces(spark, monkeypatch):
    """No file holds more than a part of the lines; each is a document, and no link is lost."""
    d = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, file_queries.s08(spark, d).collect()))
    monkeypatch.setattr(file_queries, "FILE_LINES", 50)
    found = file_queries.s08(spark, d)
    texts = [open(f.removeprefix("file://")).read() for f in found.inputFiles()]
    assert max(t.count("\n") for t in texts) < 70 and len(texts) > 10
    assert {n for t in texts for n in [ElementTree.fromstring(t)[0].tag]} == {"nodes", "links"}
    assert sorted(map(tuple, found.collect())) == whole and len(whole) > 100
