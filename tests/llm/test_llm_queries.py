import __spark_entry__ as entry


def test_problems_are_registered():
    assert {"p2_found", "p3_found", "p5_found", "p6_ids", "p7_pack", "p8_found"} <= set(entry.queries())


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tesselog"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "tesselog.llm" not in path.read_text(), path
