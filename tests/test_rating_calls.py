"""A rating is read by one call to the state, whether the entity has one or not."""

from rivalry.operators.ratings import START
from rivalry.streaming import jobs as J


class State(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def removeKey(self, key):  # noqa: N802
        del self[key]


def test_a_rating_is_read_by_one_call():
    p = J.RatedDays(20.0, 0.0)
    p.ratings, p.sizes, p.open = State({(1,): (1600.0,)}), State({(5,): (1,)}), State({(5, 0): ([7, 8], [1, 3], [2, 4], [2, 2])})
    known, out = {}, []
    p._apply("a", 5, known, out)
    assert p.ratings.calls == 4
    assert [r[3:5] for r in out] == [(1600.0, START), (START, START)] and set(known) == {1, 2, 3, 4}
