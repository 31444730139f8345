"""Steps of the near-copy join: how often links are gone through, and what members of large nodes carry along."""

from __future__ import annotations

import numpy as np
import pytest

from plantpulse.llm import components as stars
from plantpulse.llm import near_dedup


@pytest.fixture
def kept(monkeypatch):
    """The purposes of the tables that ``components`` keeps."""
    purposes: list[str] = []
    saved = stars.saved

    def noted(df, purpose):
        purposes.append(purpose)
        return saved(df, purpose)

    monkeypatch.setattr(stars, "saved", noted)
    return purposes


def _roots(spark, links):
    return {r.node: r.root for r in stars.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}


def test_links_that_are_stars_already_take_no_step(spark, kept):
    links = [(0, 1), (2, 0), (0, 3), (7, 5), (5, 6), (4, 4), (1, 0)]
    assert _roots(spark, links) == {1: 0, 2: 0, 3: 0, 6: 5, 7: 5}
    assert "small-star" not in kept


def test_no_step_follows_the_one_that_gives_stars(spark, kept):
    assert _roots(spark, [(1, 2), (0, 2)]) == {1: 0, 2: 0}
    assert kept.count("small-star") == 1


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(k, k + 1) for k in range(200, 230)]
    found = _roots(spark, links)
    least = {x: x for link in links for x in link}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {x: found.get(x, x) for x in least} == least
    assert all(x != r for x, r in found.items())


def test_members_of_a_node_carry_their_children(spark):
    rng = np.random.default_rng(6)
    sketch = rng.integers(0, 4, (40, near_dedup.COORDINATES), dtype=np.uint32)
    at = rng.integers(-(2**62), 2**62, 5)[np.arange(40) % 5]
    rows = [(k, int(at[k]), bytearray(sketch[k].tobytes()), 0, bytearray(sketch[0].tobytes())) for k in range(40)]
    met = near_dedup.met_pivots(spark.createDataFrame(rows, "key bigint, at bigint, sketch binary, pivot bigint, sp binary"), 3, 0.8).collect()
    member, child = near_dedup.children(at.view(np.uint64), 3, None, sketch, 0.8)
    expected = sorted(zip(member.tolist(), child.view(np.int64).tolist(), strict=True))
    assert sorted((r.key, c) for r in met for c in (r.one, r.two) if c is not None) == expected
    assert len(expected) > 40 and any(r.two is None for r in met)
    assert {r.key: r.agree for r in met} == {k: int((sketch[k] == sketch[0]).sum()) for k in range(40)}
