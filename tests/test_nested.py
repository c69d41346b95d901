import json
import random

from packloom.operators.nested import _DECODER, Store, _parsed_deep, opened, run_log_children, shred

RECORDS = [
    (1, json.dumps({"attempts": [{"parsed": {"evidence_chain": ["D001", {"event_id": "D002"}, None]}, "attempt": {"usage": {"prompt_tokens": "12"}}}, 5, {"parsed": None}], "groups": {"a": {"all": 3.0}, "b": {"all": None}, "c": None}})),
    (2, json.dumps(json.dumps({"attempts": {"parsed": json.dumps({"evidence_chain": "D009"}), "attempt": json.dumps({"usage": {"prompt_tokens": 7.5}})}}))),
    (3, json.dumps({"groups": [{"name": "x", "all": "0042"}, {"all": 5}, {"name": "y", "all": True}], "note": {"groups": {"z": {"all": 1}}}})),
    (4, '{"attempts": [{"parsed": {"evidence_chain": ["D001"'),
    (5, None),
    (6, ""),
    (7, "[]"),
    (8, json.dumps({"attempts": [{"parsed": {"evidence_chain": ["D001"]}}] * 2})),
    (9, '{"groups": {"big": {"all": 12345678901234567890123}, "exp": {"all": 1.5e3}}}'),
]


def test_children(spark):
    df = spark.createDataFrame(RECORDS, "record_id bigint, payload string").selectExpr("*", "'x' AS root", "'y' AS parent")
    got = sorted(map(tuple, run_log_children(Store(df, "record_id", "payload")).collect()))
    assert got == sorted(
        [
            (1, "chain", 0, 0, "D001"),
            (1, "chain", 0, 1, "D002"),
            (1, "usage", 0, 0, "12"),
            (1, "group", -1, -1, "a=3"),
            (2, "chain", 0, 0, "D009"),
            (3, "group", -1, -1, "x=42"),
            (8, "chain", 0, 0, "D001"),
            (8, "chain", 1, 0, "D001"),
            (9, "group", -1, -1, "big=12345678901234567890123"),
            (9, "group", -1, -1, "exp=1500"),
        ]
    )


def test_equal_subtrees_are_stored_once(spark):
    same = {"b": [1, {"x": "y"}], "a": None}
    rows = [(i, json.dumps({"one": same, "two": dict(reversed(same.items())), "n": i % 2})) for i in range(40)]
    store = Store(spark.createDataFrame(rows, "record_id bigint, payload string").repartition(5), "record_id", "payload")
    assert store.roots.count() == 40
    # two roots, the shared object, its array and the object inside
    assert store.nodes.count() == 5
    assert store.edges.count() == 2 * 3 + 2 + 2 + 1


def test_empty_table_and_text(spark):
    store = Store(spark.createDataFrame([], "record_id bigint, payload string"), "record_id", "payload")
    assert run_log_children(store).count() == 0 and store.edges.count() == 0
    assert opened('"plain"') == '"plain"' and opened("  {\"a\": 1}") == {"a": "1"} and opened("{broken") == "{broken"


def test_identity_ignores_member_order_but_not_place():
    ident = lambda v: shred(v, lambda *_: None)
    assert ident({"a": "1", "b": "2"}) == ident({"b": "2", "a": "1"})
    assert ident(["a", "b"]) != ident(["b", "a"]) and ident(["1"]) != ident([None]) and ident({"a": ""}) != ident({"a": None})


def test_marks_constants_and_depth(spark):
    chain = {"attempts": [{"parsed": {"evidence_chain": ["D001"]}}]}
    deep = '{"deep": ' + "[" * 50_000 + "]" * 50_000 + ', "groups": {"a": {"all": 1}}}'
    text = json.dumps(chain)
    for _ in range(12):
        text = json.dumps(text) if len(text) < 200_000 else text
    rows = [
        (1, "\ufeff" + json.dumps(chain)),
        (2, " \ufeff\n" + json.dumps(json.dumps(chain)) + "\n"),
        (3, '{"score": NaN, "other": [-Infinity], "groups": {"a": {"all": 2}, "b": {"all": NaN}}}'),
        (4, deep),
        (5, deep[:-1]),
        (6, text),
        (7, json.dumps(chain)),
        (7, json.dumps(chain)),
        (None, json.dumps({"groups": {"z": {"all": 1}}})),
    ]
    store = Store(spark.createDataFrame(rows, "record_id bigint, payload string"), "record_id", "payload")
    got = sorted(map(tuple, run_log_children(store).where("record_id IS NOT NULL").collect()))
    one = lambda i: (i, "chain", 0, 0, "D001")
    assert got == sorted([one(1), one(2), (3, "group", -1, -1, "a=2"), (4, "group", -1, -1, "a=1"), one(6), one(7), one(7)])
    assert store.edges.where("kind = 'constant'").count() == 3
    path = store.edges.inputFiles()[0]
    store.release()
    try:
        spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001 (gone)
        return
    raise AssertionError("the store is still there")


def test_own_stack_parser_is_the_decoder():
    draw = random.Random(3)

    def some(depth):
        kind = draw.randrange(8 if depth else 5)
        if kind < 5:
            return [None, True, draw.random(), draw.randrange(-9, 10**20), 'a"\\\n\u4e00{[,:]} '][kind]
        return [some(depth - 1) for _ in range(draw.randrange(4))] if kind == 5 else {f"k{i} \"": some(depth - 1) for i in range(draw.randrange(4))}

    for _ in range(300):
        value = some(4)
        text = json.dumps(value, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1]))
        assert _parsed_deep(text) == _DECODER.decode(text)
        broken = text[: draw.randrange(len(text))] + draw.choice(["", ",", "}", "]", ":", "x", '"'])
        try:
            want = _DECODER.decode(broken)
        except ValueError:
            want = ValueError
        try:
            got = _parsed_deep(broken)
        except ValueError:
            got = ValueError
        assert got == want, broken


def test_hot_subtrees(spark):
    """A third of the records, and most attempts, are one object."""
    same = {"parsed": {"evidence_chain": ["D001", "D002"]}, "attempt": {"usage": {"prompt_tokens": 7}}}
    rows = [(i, json.dumps({"attempts": [same] * (i % 3 + 1)} if i % 3 else {"attempts": same})) for i in range(900)]
    got = run_log_children(Store(spark.createDataFrame(rows, "record_id bigint, payload string").repartition(8), "record_id", "payload"))
    assert got.count() == got.distinct().count() == 3 * sum(i % 3 + 1 for i in range(900))
