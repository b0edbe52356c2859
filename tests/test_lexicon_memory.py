"""What a task of the lexicon pass holds does not grow with the batch or with the number of lexicons."""
import pyarrow as pa

from contactlake.operators import lexicon as L


class Sent:
    """A part of a lexicon that is already on the worker."""

    def __init__(self, table):
        self.value, self.sparkSession, self.sparkContext = table, self, self

    def toArrow(self):
        return self.value

    def broadcast(self, _):
        return self


def part(rows):
    return Sent(pa.table({"who": pa.array([r[0] for r in rows], pa.string()), "grp": pa.array([r[1] for r in rows], pa.int32()),
                          "term": pa.array([r[2] for r in rows], pa.string())}))


def found(rows, texts, by=()):
    batch = pa.RecordBatch.from_pylist(texts, pa.schema({"k": pa.int32(), "who": pa.string(), "text": pa.string()}))
    return list(L._pass(part(rows), ["k"], by, "text", "term", ["grp", "term"])(iter([batch])))


def test_found_rows_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "FOUND_ROWS", 50, raising=False)
    rows = [("x", i, t) for i in range(4) for t in ("a", "ab", "é")]
    texts = [dict(k=k, who="x", text="ab é a") for k in range(100)]
    out = found(rows, texts)
    assert max(b.num_rows for b in out) <= 50
    got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    assert got == sorted((k, i, t, p, n) for k in range(100) for i in range(4) for t, p, n in (("a", 1, 2), ("ab", 1, 1), ("é", 4, 1)))


def test_a_term_of_many_owners_is_found_for_the_text_s_own(monkeypatch):
    rows = [(f"w{i}", i, "ab") for i in range(3000)]
    out = found(rows, [dict(k=1, who="w7", text="xab"), dict(k=2, who=None, text="ab"), dict(k=3, who="zz", text="ab"), dict(k=4, who="w7", text=None)], ("who",))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(1, 7, "ab", 2, 1)]


def test_large_machines_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(L, "LIMIT_BYTES", 4_000)
    L._machines.clear()
    for k in range(4):
        found([("x", i, f"term{k}-{i}") for i in range(40)], [dict(k=1, who="x", text=f"term{k}-3")])
    assert len(L._machines) == 1
    for k in range(3):
        found([("x", 1, f"t{k}")], [dict(k=1, who="x", text="t0")])
    assert len(L._machines) == 4
