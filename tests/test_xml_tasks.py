"""How many tasks read a folder of XML, and that each range is read once."""

from textloom.sources import xml_splits


def test_a_task_reads_many_ranges(tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"f{i}.xml").write_text("".join(f"<p><!-- <t>no</t> --><t>{i} {k}</t></p>" for k in range(2000)))
    options = {"path": str(tmp_path), "tag": "t", "split": "256", "mode": "read"}
    reader = xml_splits.SplitReader(options | {"entries": '{"f0.xml:256": 300}'})
    tasks = reader.partitions()
    ranges = [r for t in tasks for r in t.ranges]
    assert len(ranges) > 800 and len(tasks) < 2 * xml_splits.TASKS and reader.entries == {}
    assert next(r.entry for r in ranges if r.path == "f0.xml" and r.begin == 256) == 300
    monkeypatch.setattr(xml_splits, "TASK", 1000)
    assert len(xml_splits.SplitReader(options).partitions()) > 200


def test_ranges_of_one_task_as_of_many(spark, tmp_path):
    texts = [f"{k} " + "x" * (k % 700) for k in range(1500)]
    (tmp_path / "f.xml").write_text("".join(f"<p><!-- <t>no</t> --><t>{t}</t><![CDATA[<t>no]]></p>" for t in texts))
    got = xml_splits.read_xml_splits(spark, str(tmp_path), "t", 512).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == texts and [r["doc_id"] for r in got] == list(range(len(texts)))
