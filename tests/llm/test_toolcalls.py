import json
import random

from helixloom.llm import toolcalls

SCHEMAS = {"f": (("x", "integer", True), ("s", "string", False))}
CALLS = "id string, place int, name string, arguments string, after array<string>"
RESULTS = "id string, place int, content string"


def test_links_order_and_validation(spark):
    calls = spark.createDataFrame(
        [
            ("a", 1, "f", '{"s":"é\\n", "x":1}', None),
            ("b", 2, "f", '{"x":"1"}', ["a"]),
            ("c", 3, "f", "not json", ["b", "a", "b", None]),
            ("d", 4, "g", "{}", ["c"]),
            ("e", 5, "f", '{"x":2,"y":3}', ["e"]),
            ("h", 6, "f", '{"x":2}', ["gone"]),
            ("h", 7, "f", '{"x":3}', ["a"]),
            ("h", 7, "f", '{"x":3}', ["a"]),
            (None, 8, "f", '{"x":3}', ["a"]),
            ("i", 9, "f", None, ["d", "h", "gone"]),
            ("j", 10, None, '{"x":[1.0,1e2,-2.50,"a\\"1.0\\\\",{"z":1e-3,"a":0.10}]}', ["e", "a"]),
        ],
        CALLS,
    )
    results = spark.createDataFrame([("a", 2, "one"), ("a", 1, "zero"), ("z", 9, "lost"), (None, 3, "n"), ("b", 3, None)], RESULTS)
    rows = toolcalls.link(calls, results, SCHEMAS).collect()
    got = {r.id: r for r in rows if r.status not in ("repeated", "unidentified")}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "h": 0, "i": 4, "j": None, "z": None}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "linked", "z": "orphan"} | dict.fromkeys("cdehij", "unanswered")
    assert {k: r.valid for k, r in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "h": True, "i": False, "j": False, "z": None}
    assert {k: r.message for k, r in got.items()} == {
        "a": '{"arguments":{"s":"é\\n","x":1},"id":"a","name":"f","result":"zero"}',
        "b": '{"arguments":{"x":"1"},"id":"b","name":"f"}',
        "c": '{"arguments":"not json","id":"c","name":"f"}',
        "d": '{"arguments":{},"id":"d","name":"g"}',
        "e": '{"arguments":{"x":2,"y":3},"id":"e","name":"f"}',
        "h": '{"arguments":{"x":2},"id":"h","name":"f"}',
        "i": '{"arguments":null,"id":"i","name":"f"}',
        "j": '{"arguments":{"x":[1,100,-2.5,"a\\"1.0\\\\",{"a":0.1,"z":0.001}]},"id":"j"}',
        "z": '{"arguments":null,"id":"z","result":"lost"}',
    }
    apart = sorted((r.status, str(r.id), str(r.place), str(r.result_place), r.message) for r in rows if r.status in ("repeated", "unidentified"))
    assert apart == [
        ("repeated", "a", "None", "2", '{"arguments":null,"id":"a","result":"one"}'),
        ("repeated", "h", "7", "None", '{"arguments":{"x":3},"id":"h","name":"f"}'),
        ("repeated", "h", "7", "None", '{"arguments":{"x":3},"id":"h","name":"f"}'),
        ("unidentified", "None", "8", "None", '{"arguments":{"x":3},"name":"f"}'),
        ("unidentified", "None", "None", "3", '{"arguments":null,"result":"n"}'),
    ]
    assert all(json.loads(r.message) for r in rows)


def test_levels_equal_plain_recursion(spark):
    rng = random.Random(4)
    rows, edges = [], {}
    for i in range(120):
        up = [f"n{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else []
        edges[f"n{i}"] = up
    edges |= {"p": ["q"], "q": ["r"], "r": ["p"], "behind": ["p", "n3"], "chain0": ["p"]}
    rows = [(k, v) for k, v in edges.items()]

    def level(k):
        return max((level(u) + 1 for u in edges[k]), default=0)

    got = {r.id: r.level for r in toolcalls.levels(spark.createDataFrame(rows, "id string, after array<string>")).collect()}
    assert got == {k: None if k in "pqr" or k in ("behind", "chain0") else level(k) for k in edges}


def test_long_strings_and_repeated_turns(spark):
    text = 'quote " and \\ 1.0 ' * 20_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 0, "user", "other"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 2, "user", "y"), (1, None, "assistant", "z"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    rows = toolcalls.link(*toolcalls.from_conversations(turns)).collect()
    assert len(rows) == 6 and sorted(r.status for r in rows) == ["linked", "repeated", "repeated", "unanswered", "unidentified", "unidentified"]
    assert text in [json.loads(r.message)["arguments"]["text"] for r in rows if r.id == "1:0" and r.name]


def test_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.from_conversations(turns)).count() == 0
