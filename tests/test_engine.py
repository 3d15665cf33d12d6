import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tesselog.engine import Config, Models, SearchIndex
from tesselog.functions import vectors as V
from tesselog.operators import retrieval as R
from tesselog.operators.index_store import IndexStore, git_info, git_state


def provider(text):
    return V.hashed_vector(F.coalesce(text, F.lit("")), 16)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_build_search_refresh(spark, tmp_path):
    (tmp_path / "a.py").write_text("def parse_user(x):\n    return x\n\n\ndef other():\n    return 1\n")
    (tmp_path / "b.py").write_text("def render():\n    return 'page'\n")
    (tmp_path / "bin").write_bytes(b"\0\1")
    index = SearchIndex.build(spark, str(tmp_path), provider)
    path = {r.chunk_id: r.path for r in index.chunks.collect()}
    assert index.size() == len(path) == 3 and index.has_embeddings
    first = index.search(ask(spark, "parse_user", "nothinghere"), 3).orderBy("query_id", "rank").collect()
    assert path[first[0].chunk_id] == "a.py" and first[0].source == "bm25" and {r.query_id for r in first} == {0}
    content = index.chunks.where("symbol_name = 'render'").first().content
    hybrid = index.search_hybrid(ask(spark, content), 2).orderBy("rank").collect()
    assert path[hybrid[0].chunk_id] == "b.py" and hybrid[0].source == "hybrid"
    assert index.search(ask(spark, "parse_user"), 2, rerank=R.mock_relevance).count() >= 1
    region = spark.createDataFrame([(1, "a.py", 1, 2), (2, "none.py", 1, 2)], "query_id bigint, file_path string, start_line int, end_line int")
    related = index.find_related(region, 2).collect()
    assert {r.query_id for r in related} == {1} and len(related) == 2

    (tmp_path / "a.py").write_text("def parse_user(x):\n    return x\n\n\ndef changed():\n    return 2\n")
    os.utime(tmp_path / "a.py", (1, 1))
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").write_text("def fresh():\n    return 3\n")
    again, delta = index.refresh()
    assert (delta.added, delta.modified, delta.removed, delta.embeds_recomputed) == (1, 1, 1, 2)
    assert {r.path for r in again.chunks.collect()} == {"a.py", "c.py"}
    third, same = again.refresh()
    assert (same.added, same.modified, same.removed, same.embeds_recomputed) == (0, 0, 0, 0) and third.size() == again.size()


def test_without_provider_and_empty(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one two\n")
    index = SearchIndex.build(spark, str(tmp_path))
    assert not index.has_embeddings and index.search_hybrid(ask(spark, "two"), 5).first().source == "bm25"
    (tmp_path / "x.txt").unlink()
    empty = SearchIndex.build(spark, str(tmp_path))
    assert empty.size() == 0 and empty.search(ask(spark, "two"), 5).count() == 0


def test_index_cache(spark, tmp_path):
    """The same state is loaded, another state or model is built; what is loaded answers alike."""
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def parse_user(x):\n    return x\n")
    store = IndexStore(spark, f"file://{tmp_path}/cache")
    seen = []
    build = lambda **k: SearchIndex.build(spark, str(tree), store=store, progress=lambda phase, n: seen.append((phase, n)), **k)
    first = build(provider=provider, model="p")
    assert not first.cache_hit and seen == [("walked", 1), ("chunked", 1), ("embedded", 1)]
    seen.clear()
    second = build(provider=provider, model="p")
    assert second.cache_hit and seen == [("walked", 1), ("cached", 1)] and second.has_embeddings
    rows = lambda index: [tuple(r) for r in index.search_hybrid(ask(spark, "parse user"), 3).collect()]
    assert rows(first) == rows(second)
    assert not build().cache_hit and build().cache_hit
    os.utime(tree / "a.py", (1, 1))
    assert not build(provider=provider, model="p").cache_hit
    _, delta = build(provider=provider, model="p").refresh()
    assert (delta.added, delta.modified, delta.removed) == (0, 0, 0)


def test_a_saved_state_is_one_save(spark, tmp_path, monkeypatch):
    """A second save of a state that breaks off leaves the first; one that ends replaces it whole."""
    store = IndexStore(spark, f"file://{tmp_path}/cache")
    store.save("r", "s", {"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.save("r", "s", {"a": spark.range(9), "b": broken})
    assert {k: v.count() for k, v in store.load("r", "s").items()} == {"a": 3, "b": 4}
    store.save("r", "s", {"a": spark.range(7)})
    assert {k: v.count() for k, v in store.load("r", "s").items()} == {"a": 7}


def test_states_of_a_working_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "repo"), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True).stdout.decode().strip()
    (tmp_path / "repo").mkdir()
    assert git_state(str(tmp_path / "repo")) is None
    git("init", "-q", "-b", "main")
    (tmp_path / "repo" / "a.txt").write_text("one\n")
    git("add", "."), git("commit", "-qm", "one")
    head = git("rev-parse", "HEAD")
    assert git_state(str(tmp_path / "repo")) == head
    (tmp_path / "repo" / "a.txt").write_text("two\n")
    dirty = git_state(str(tmp_path / "repo"))
    assert dirty.startswith(head + ":") and len(dirty) == 40 + 1 + 64
    (tmp_path / "repo" / "a.txt").write_text("three\n")
    assert git_state(str(tmp_path / "repo")) not in (head, dirty)
    git("checkout", "-q", "--", "."), git("worktree", "add", "-q", "-b", "side", str(tmp_path / "side"))
    (tmp_path / "repo" / "sub").mkdir()
    asked = spark.createDataFrame([(str(tmp_path / p),) for p in ("repo", "repo/sub", "side", "none", "repo")] + [(None,)], "cwd string")
    root = os.path.realpath(tmp_path / "repo")
    got = {os.path.relpath(r.cwd, tmp_path): (r.project_root, r.is_worktree, r.branch) for r in git_info(asked).collect()}
    assert got == {"repo": (root, False, "main"), "repo/sub": (root, False, "main"), "side": (root, True, "side")}


def test_settings_and_models(tmp_path):
    config = Config(str(tmp_path / "deep" / "config.json"))
    assert config.load() == {}
    config.save(embedder="hashed")
    assert config.load() == {"embedder": "hashed"} and os.listdir(tmp_path / "deep") == ["config.json"]
    (tmp_path / "deep" / "config.json").write_text("{broken")
    assert config.load() == {}
    with pytest.raises(ValueError):
        config.save(colour="red")
    models = Models()
    models.add("slow", lambda: provider, kind="embed", cold_start_min=9.0)
    models.add_prefix("hf:", lambda name: name)
    assert models.listed() == ["bm25", "hashed", "slow"] and models.provider("bm25") is None and models.provider("slow") is provider
    assert models.provider("hf:owner/model") == "owner/model"
    for name in ("hf:", "other"):
        with pytest.raises(ValueError):
            models.provider(name)


def test_arguments_are_checked(spark, tmp_path):
    (tmp_path / "x.py").write_text("a = 1\n")
    index = SearchIndex.build(spark, str(tmp_path))
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            index.search(ask(spark, "a"), k)
    for lines in ((0, 1), (3, 2), (None, 2)):
        with pytest.raises(ValueError):
            index.find_related(spark.createDataFrame([(1, "x.py", *lines)], "query_id bigint, file_path string, start_line int, end_line int"))
    with pytest.raises(Exception, match="size 4"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(V.same_size(F.col("v"), 4)).collect()
