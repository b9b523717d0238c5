"""Cases of the fourth review."""

import random

import pytest


class Held(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def removeKey(self, key):
        self.calls += 1
        del self[key]


@pytest.fixture
def orders_dir(spark, tmp_path):
    """Orders of two days and ten codes; some keys come twice, some values are missing."""
    rng = random.Random(4)
    rows = [(k, rng.randint(1, 60), rng.choice("FPO"), float(rng.randint(0, 600_000))) for k in range(2400, 3900)]
    rows += [(k, c, s, p if k % 2 else None) for k, c, s, p in rng.sample(rows, 60)]
    rows += [(k, None if k % 2 else c, None, p) for k, c, s, p in rng.sample(rows, 60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_snapshots_are_those_of_the_plain_joins_and_take_one_shuffle(spark, orders_dir):
    from pyspark.sql import functions as F

    from tidemark.plans import queries_book as Q
    from tidemark.plans import views as V

    text = Q.SNAPSHOTS.replace("n / 7", "n div 7").replace("(n + 6) / 7", "(n + 6) div 7")
    levels = spark.sql(text, log=V.book_events(spark, orders_dir)).withColumns({c: F.col(c).cast("bigint") for c in Q.HEAD[2:9]})
    want = [tuple(r) for r in levels.selectExpr(*Q.HEAD, "side", "level", "cast(price as double)", "cast(volume as bigint)", "cast(orders as bigint)").collect()]
    found = Q.snapshots(spark, orders_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = [(*r[:11], side, level, *x) for r in found.collect() for side, xs in (("B", r.bids), ("S", r.asks)) for level, x in enumerate(xs, 1)]
    assert len(want) > 1000 and sorted(got, key=repr) == sorted(want, key=repr)
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_small_book_is_few_state_calls():
    """Three hundred orders, their levels and ladders are one page; before, each was a call of its own."""
    from tidemark.streaming import ordered as O

    held = Held()
    book = O._Cached(held, fresh=True)
    ladder = O.Ladder(book, "B")
    for i in range(300):
        book.put((i,), ("B", i % 20, 5))
        if i < 20:
            ladder.add(i)
    book.flush()
    assert held.calls == 1
    again = O._Cached(held)
    assert again.get((299,)) == ("B", 19, 5) and O.Ladder(again, "B").best(3) == [19, 18, 17] and held.calls <= 4


def test_pages_of_a_large_book_stay_small(monkeypatch):
    """Entries come and go over many calls; pages split, few are held at a time, and nothing is left of an empty book."""
    import pickle

    from tidemark.streaming import ordered as O

    monkeypatch.setattr(O._Cached, "HELD", 8)
    rng, held, plain = random.Random(5), Held(), {}
    for i in range(40):
        book = O._Cached(held, fresh=i == 0)
        for _ in range(400):
            key = rng.choice([(rng.randint(0, 10**12),), (rng.choice("BS"), rng.randint(0, 99)), ("B", rng.randint(0, 9), rng.randint(0, 10**9))])
            assert book.get(key) == plain.get(key)
            plain[key] = (rng.randint(0, 9),)
            book.put(key, plain[key])
            gone = rng.choice(list(plain))
            if rng.random() < 0.2:
                del plain[gone]
                book.put(gone, None)
            assert len(book.known) <= 8
        book.flush()
    pages = {k: pickle.loads(v[0]) for k, v in held.items()}
    number, entries = pages.pop((-1,))
    assert number > 8 and entries == len(plain) == sum(map(len, pages.values()))
    assert {k: v for page in pages.values() for k, v in page.items()} == plain
    assert max(map(len, pages.values())) < 4 * O._Cached.PAGE
    book = O._Cached(held)
    for key in plain:
        book.put(key, None)
    book.flush()
    assert not held


def counted(monkeypatch, name):
    """The calls of a function of the book."""
    from tidemark.operators import book as K

    calls, whole = [], getattr(K, name)
    monkeypatch.setattr(K, name, lambda *a, **k: calls.append(1) or whole(*a, **k))
    return calls


def test_own_best_prices_number_the_events_once(spark, monkeypatch):
    """Prices change no position; an event before its order's insert stays without one."""
    from tidemark.operators import book as K

    rows = [(1, "trade", 7, "B", 3, 1), (2, "insert", 1, "B", 10, 5), (3, "insert", 7, "B", None, 5), (4, "insert", 7, "B", None, 9),
            (5, "cancel", 1, "B", 10, 5), (6, "insert", 8, "B", None, 2), (7, "insert", 9, "S", None, 2)]
    events = spark.createDataFrame([(1, 1, *r) for r in rows], "SecuCode long, TradingDay long, seq long, kind string, order_id long, side string, price long, qty long")
    calls = counted(monkeypatch, "number_rows")
    got = {r.seq: (r.price, r.best_bid, r.best_ask) for r in K.best_prices(events).collect()}
    assert len(calls) == 1
    assert got == {1: (None, 0, 0), 2: (10, 10, 0), 3: (10, 10, 0), 4: (10, 10, 0), 5: (10, 10, 0), 6: (10, 10, 0), 7: (0, 10, 0)}


def test_snapshots_are_verified_with_one_pass_over_the_orders(spark, orders_dir, monkeypatch):
    from tidemark.plans import queries_book as Q

    calls = counted(monkeypatch, "dealt")
    found = Q.checked(spark, orders_dir)
    assert len(calls) == 1
    assert found.count() == Q.snapshots(spark, orders_dir).count() and found.where("ok").count() > 0
