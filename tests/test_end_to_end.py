"""Sample documents to answers, through the command line's functions."""

from graphloom import __main__ as cli


def test_ingest_discover_query(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "mars.md").write_text("# Rover\n\nThe rover contains a battery. " + "The battery powers the motor of the rover while it drives over the red plain each day. " * 3 + "\n\n## Arm\n\nThe arm controls the drill. " + "Samples of rock are taken by the drill and kept in sealed tubes for a later return. " * 3)
    (docs / "sun.txt").write_text("A solar panel is a type of power source. " + "Panels turn light into current for the bus and need to be clean to work well all day. " * 3)
    paths = [f"file://{docs}"]
    store = str(tmp_path / "store")
    assert cli.ingest(spark, store, paths)["documents"] == 2
    hits = cli.query(spark, store, "What does the drill do with rock samples?", 3)["hits"]
    assert "drill" in hits[0]["text"]
    assert "drill" in cli.discover_report(spark, store, "markdown")
    (docs / "sun.txt").write_text("changed")
    (docs / "new.txt").write_text("new")
    got = cli.update(spark, store, paths, [f"file:{docs}"])
    assert got == {"unchanged": 1, "modified": 1, "new": 1}
