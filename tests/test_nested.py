import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselog.functions import structural
from tesselog.operators import nested

TYPES = set(nested.BLOCK_TYPES)
SCHEMA = "line_id bigint, file string, line_no int, value string, received_at timestamp, path string, record string"


def by_hand(text):
    """(path, parent, type) of the blocks of one line, by walking the parsed value."""
    out = []
    try:
        root = json.loads(text)
    except (ValueError, TypeError):
        return out
    if not isinstance(root, dict):
        return out

    def opened(v):
        if isinstance(v, str):
            try:
                got = json.loads(v)
            except ValueError:
                return v
            return got if isinstance(got, (dict, list)) else v
        return v

    def join(path, key):
        return f"{path}.{key}" if path else str(key)

    def content(c, path, block):
        c = opened(c)
        items = [(path, c)] if isinstance(c, dict) else [(join(path, i), x) for i, x in enumerate(c)] if isinstance(c, list) else []
        for p, x in items:
            if isinstance(x, dict) and isinstance(x.get("type"), str) and x["type"] in TYPES:
                out.append((p, block, x["type"]))
                if "content" in x:
                    content(x["content"], join(p, "content"), p)
            elif block == "":
                walk(x, p)

    def walk(x, path):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == "message" and isinstance(opened(v), dict):
                    message(opened(v), join(path, k))
                elif not isinstance(v, str):
                    walk(v, join(path, k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, join(path, i))

    def message(m, path):
        for k, v in m.items():
            if k == "content":
                content(v, join(path, k), "")
            elif k == "message" and isinstance(opened(v), dict):
                message(opened(v), join(path, k))
            elif not isinstance(v, str):
                walk(v, join(path, k))

    walk(root, "")
    return sorted(out)


def vectorised(texts):
    _, blocks, _ = nested._flatten([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts])
    out = [[] for _ in texts]
    for b in blocks:
        out[b[0]].append((b[2], b[3], b[5]))
    return [sorted(x) for x in out]


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", "text", "tool_use", 'a"b\\', "{", "[1]", "é中😀", "\\\\"])
keys = st.sampled_from(["message", "content", "type", "id", "data", 'q"\\'])
value = st.recursive(leaf, lambda c: st.lists(c, max_size=4) | st.dictionaries(keys, c, max_size=4) | st.builds(lambda x: json.dumps(x), c), max_leaves=25)
block = st.fixed_dictionaries({"type": st.sampled_from(["text", "tool_use", "tool_result", "error"]), "content": value})
line = st.fixed_dictionaries({"message": st.fixed_dictionaries({"content": st.lists(block | value, max_size=3) | block | value}), "data": value})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(line, st.booleans(), st.integers(0, 40)), max_size=5))
def test_flatten_equals_walk(cases):
    texts = []
    for x, ascii_, cut in cases:
        t = json.dumps(x, ensure_ascii=ascii_, indent=1 if cut % 3 == 0 else None)
        texts.append(t[: -cut // 2] if cut > 35 else t)
    assert vectorised(texts) == [by_hand(t) for t in texts]


@pytest.mark.parametrize("text", [None, "", "   ", "[]", "null", "3", '{"message":', '"message"', '{"message": {"content": [}', '{"a": 1}}', '{"a" 1}'])
def test_lines_without_blocks(text):
    assert vectorised([text, '{"message": {"content": [{"type": "text"}]}}'])[0] == []


def test_index_depths_and_keys():
    text = b' {"a": [1, {"b": "]"}], "c": {}} '
    nodes = structural.index(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(nodes.raw(i) for i in range(len(nodes.text))) == sorted([text.strip(), b'[1, {"b": "]"}]', b"1", b'{"b": "]"}', b'"]"', b"{}"])
    assert nodes.depth.tolist().count(1) == 2 and nodes.depth.max() == 3


def rows(spark, *lines):
    return spark.createDataFrame([(i, f, n, v, None, "x", "y") for i, f, n, v in lines], SCHEMA)


def test_links_and_repeated_rows(spark):
    use = lambda i: json.dumps({"message": {"content": [{"type": "tool_use", "id": i}]}})
    res = lambda key, i: json.dumps({"message": {"content": {"type": "tool_result", key: i, "content": '[{"type": "text", "text": "x"}]'}}})
    df = rows(
        spark,
        (1, "a", 3, use("u")), (2, "a", 2, use("u")), (3, "a", 1, res("toolUseId", "u")), (3, "a", 1, res("toolUseId", "u")),
        (4, "b", 1, res("tool_use_id", "u")), (5, "a", 9, res("tool_use_id", None)), (6, "a", 5, res("tool_use_id", 7)), (7, "a", 6, use(7)),
        (8, None, None, res("tool_use_id", "n")), (9, None, None, use("n")), (None, "a", 1, use("z")), (10, "a", 1, None),
    )
    got = {(r.line_id, r.block_path): (r.parent_path, r.use_line_id, r.use_path) for r in nested.found_blocks(df).collect()}
    assert got[(3, "message.content")] == ("", 2, "message.content.0")
    assert got[(3, "message.content.content.0")] == ("message.content", -1, "")
    assert got[(4, "message.content")] == ("", -1, "")
    assert got[(5, "message.content")] == ("", -1, "")
    assert got[(6, "message.content")] == ("", 7, "message.content.0")
    assert got[(8, "message.content")] == ("", 9, "message.content.0")
    assert None not in {k[0] for k in got} and 10 not in {k[0] for k in got}


def test_lines_table_and_empty_table(spark):
    df = rows(spark, (1, "a", 1, "{}"), (2, "a", 2, "[]"), (3, "a", 3, None), (4, "a", 4, '{"message": {"role": "user"}}'))
    flat = nested.flatten(df)
    assert {r.line_id: r.is_object for r in flat.where("record = 'line'").collect()} == {1: True, 2: False, 3: False, 4: True}
    assert [(r.path, r.role) for r in flat.where("record = 'message'").collect()] == [("message", "user")]
    assert nested.found_blocks(rows(spark).limit(0)).count() == 0


def test_very_long_line(spark):
    text = json.dumps({"message": {"content": [{"type": "text", "text": "x" * 3_000_000}, *[{"type": "text"}] * 2000]}})
    assert nested.found_blocks(rows(spark, (1, "a", 1, text))).count() == 2001


@pytest.mark.parametrize("text", ['{"a":[1,-2.5e3,true,null,NaN,"x\\u00e9\\n"],"b":{},"c":[]}', " [ ] ", '{"a":1,}', "[1,]", "[,1]", '{"a"}', '{"a" 1}', '{1:2}', '["\\x"]', '["\t"]', "[01]", "[1 2]", "[1}", "[-]", "[1.]", "", "5", '"a', "{} {}", '{"a":}', "[tru]", '{"a":1 "b":2}', "[:]", '[{"a":[{}]}]'])
def test_validity_equals_the_parser(text):
    raw = text.encode()
    try:
        want = isinstance(json.loads(raw), (dict, list))
    except ValueError:
        want = False
    assert structural.index(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).valid.tolist() == [want]


def test_validity_of_damaged_texts_equals_the_parser():
    """Thousands of texts in one index, most of them with a byte changed, put in or taken out."""
    rng = random.Random(5)

    def value(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.5:
            return rng.choice([1, 0, -1.5, 1e10, "a", 'x"\\y\\', "é\n", "", True, None, "{", "]", "a:b,c"])
        if r < 0.75:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b:", 'c,"', "d{"]): value(depth + 1) for _ in range(rng.randrange(4))}

    texts, want = [], []
    while len(texts) < 4000:
        got = value()
        if not isinstance(got, (dict, list)):
            continue
        b = bytearray(json.dumps(got, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode())
        for _ in range(rng.randrange(3)):
            k, r = rng.randrange(len(b)), rng.random()
            if r < 0.4:
                b[k] = rng.choice(b'{}[],:"\\ 0123-+.eEtu\n\x01nulx\xc3')
            elif r < 0.7:
                b[k:k] = bytes([rng.choice(b'{}[],:"\\ 01-+.eEnu\t\x02')])
            elif len(b) > 1:
                del b[k]
        try:
            want.append(isinstance(json.loads(b.decode()), (dict, list)))
        except ValueError:
            want.append(False)
        texts.append(bytes(b))
    nodes = structural.index(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert nodes.valid.tolist() == want and 1000 < sum(want) < 3500


@pytest.mark.parametrize("levels", [1_200, 60_000])
def test_lines_nested_deeper_than_the_parser(levels):
    deep = "[" * levels + "]" * levels
    good = f'{{"z":{deep},"message":{{"content":[{{"type":"text","text":"a"}}]}}}}'
    under = f'{{"z":{"[" * levels}{{"message":{{"content":{{"type":"text"}}}}}}{"]" * levels}}}'
    bad = good.replace("[]", "[,]", 1)
    messages, blocks, objects = nested._flatten([good.encode(), bad.encode(), under.encode()])
    assert objects == {0, 2}
    assert [(b[0], b[2]) for b in blocks] == [(0, "message.content.0"), (2, "z" + ".0" * levels + ".message.content")]
    assert [m[2] for m in messages] == ["message", "z" + ".0" * levels + ".message"]


def test_blocks_nested_deeper_than_calls_go():
    levels = 1_500
    line = '{"message":{"content":' + '{"type":"tool_result","content":' * levels + '""' + "}" * levels + "}}"
    blocks = sorted(nested._flatten([line.encode()])[1], key=lambda b: len(b[2]))
    path = ["message" + ".content" * (i + 1) for i in range(levels)]
    assert [(b[2], b[3]) for b in blocks] == list(zip(path, ["", *path]))
