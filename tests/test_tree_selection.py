"""Elements that selectors mean, against trying every chain on every node."""

import random

from foliolens.functions import selectors
from foliolens.operators import steps, tree

SELECTORS = ["p", "p, h2, .x", "div p", "div .x, li", "#a", "[k]", "p[k=v], b", "*", "div div b", ".x .x"]


def test_selection_is_that_of_every_chain_on_every_node():
    rng = random.Random(7)
    for _ in range(60):
        made = "".join(rng.choice(["<div>", '<div class="x y">', "<p>", '<p k="v">', '<b id="a">', '<li k class="x">', "</div>", "</p>", "</b>", "text", "<br>"]) for _ in range(40))
        root = tree.parse(made)
        for selector in SELECTORS:
            plain = [n for n in root.walk() if any(tree._fits(n, chain) for chain in selectors.parse(selector))]
            assert root.all(selector) == plain and root.first(selector) is (plain[0] if plain else None), (made, selector)
        blocks = [n for n in root.walk() if n.tag in steps.BLOCKS and not any(a.tag in steps.BLOCKS for a in n.parent.around())]
        assert steps.blocks(root) == blocks


def test_tags_alone_are_looked_up(monkeypatch):
    root, tried = tree.parse("<div><p>a<b>c</b></p></div>" * 50), []
    fits = tree._fits
    monkeypatch.setattr(tree, "_fits", lambda *a: tried.append(a) or fits(*a))
    assert len(root.all("p, b")) == 100 and root.all(".none, #none") == [] and not tried
