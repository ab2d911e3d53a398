"""Programs that say the same have one form, others have not."""

import pytest

from tessella.operators import canonical as C
from tessella.operators import structure

SOURCES = [
    "def f(xs, n):\n    s = 0\n    for i in range(n):\n        if xs[i] > 3 and n != i:\n            s += xs[i] * 2\n        else:\n            s = s - 1\n    return s\n",
    "def g(a, b):\n    t = []\n    for k in range(len(a)):\n        if a[k] == b:\n            t.append(k)\n    return t\n",
    "def h(n):\n    while n >= 10:\n        n = n // 2\n    return n <= 5 or n == 7\n",
    "def area(w, h):\n    if w < 0:\n        raise ValueError(w)\n    return w * h\n",
]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_clones_meet_their_source_and_others_do_not(kind):
    forms = [C.canonical(s) for s in SOURCES]
    assert len(set(forms)) == len(SOURCES)
    for s, form in zip(SOURCES, forms):
        for seed in range(5):
            assert C.canonical(structure.clone(s, kind, seed)) == form, structure.clone(s, kind, seed)
        assert C.canonical(form) == form


@pytest.mark.parametrize(
    "a,b",
    [
        ("x = a + b * 2\n", "y = 2 * b + a\n"), ("if not (a < b):\n    f()\nelse:\n    g()\n", "if b <= a:\n    f()\nelse:\n    g()\n"),
        ("if a != 1:\n    f()\nelse:\n    g()\n", "if 1 == a:\n    g()\nelse:\n    f()\n"), ("x: int = 1 + 2\n", "x = 3\n"), ("p(not not a)\n", "p(a)\n"),
        ("def f(a: int) -> int:\n    'doc'\n    return a\n", "def f(b):\n    return b\n"), ("for i in range(2, n):\n    p(i)\n", "i = 2\ne = n\nwhile e > i:\n    p(i)\n    i = 1 + i\n"),
        ("x = (a and b) and c.d\n", "x = a and (c.d and b)\n"),
    ],
)
def test_one_form(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize("a,b", [("x = a - b\n", "x = b - a\nc = a\n"), ("p(a < b)\n", "p(a <= b)\n"), ("if a:\n    f()\n", "while a:\n    f()\n"), ("p(1)\n", "p('1')\n"), ("for i in range(n):\n    break\n", "i = 0\ne = n\nwhile i < e:\n    break\n    i += 1\n")])
def test_other_forms(a, b):
    assert C.canonical(a) != C.canonical(b)


def test_scores(spark):
    code = [(1, SOURCES[0]), (2, structure.clone(SOURCES[0], 4, 1)), (3, SOURCES[1]), (4, "not ( python"), (5, None), (6, "")]
    programs = spark.createDataFrame(code, "id long, code string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 4), (5, 6)], "id_a long, id_b long")
    got = {(r["id_a"], r["id_b"]): (r["equal"], r["score"]) for r in C.canonical_scores(pairs, programs).collect()}
    assert got[1, 2] == (True, 1.0) and not got[1, 3][0] and 0 < got[1, 3][1] < 1 and got[1, 4] == (False, 0.0) and not got[4, 4][0]


def made(rng, depth=0):
    """A few simple statements, dead ones among them."""
    name = lambda: rng.choice("abcxyz")

    def value(d=0):
        k = rng.randrange(9 if d < 3 else 3)
        if k < 2:
            return name()
        if k == 2:
            return str(rng.choice([0, 1, 2, 7, -3, True]))
        if k == 3:
            return f"f({value(d + 1)})"
        if k == 4:
            return f"(not {value(d + 1)})"
        if k == 5:
            return f"({value(d + 1)} {rng.choice(['and', 'or'])} {value(d + 1)})"
        if k == 6:
            return f"({value(d + 1)} {rng.choice(['<', '<=', '>', '>=', '==', '!=', 'is', 'in'])} {value(d + 1)})"
        return f"({value(d + 1)} {rng.choice(['+', '-', '*', '//', '**', '|'])} {value(d + 1)})"

    pad, out = "    " * (depth + 1), ""
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(11 if depth < 2 else 5)
        if k < 2:
            out += f"{pad}{name()} = {value()}\n"
        elif k == 2:
            out += f"{pad}{name()} += {value()}\n"
        elif k == 3:
            out += f"{pad}f({value()})\n"
        elif k == 4:
            out += pad + rng.choice(["return " + value(), "pass", f"{name()} = {name()} = 3", "return"]) + "\n"
        elif k < 8:
            out += f"{pad}if {rng.choice([value(), '0', '1'])}:\n{made(rng, depth + 1)}" + (f"{pad}else:\n{made(rng, depth + 1)}" if rng.random() < 0.5 else "")
        elif k == 8:
            out += f"{pad}while {rng.choice([value(), '0'])}:\n{made(rng, depth + 1)}"
        else:
            out += f"{pad}for {name()} in {rng.choice(['range(9)', 'range(2, a)', name()])}:\n{made(rng, depth + 1)}"
    return out


def test_forms_from_known_statements_equal_those_of_whole_programs(monkeypatch):
    import random

    rng, forms = random.Random(11), C.Forms()
    sources = ["".join(f"def f{k}({', '.join(rng.sample('abc', rng.randrange(3)))}):\n{made(rng)}" for k in range(rng.randrange(1, 4))) for _ in range(400)]
    want = [C.canonical(s) for s in sources]
    seen = []
    monkeypatch.setattr(C, "canonical", lambda s, f=C.canonical: seen.append(s) or f(s))
    assert [forms.form(s) for s in sources] == want and not seen
    odd = [None, "", "x = 1\n", "def f(:", *SOURCES, "def f(a, b=1):\n    return a\n", "def f(a):\n    'doc'\n    return a\n", "def f(a):\n    x = lambda: a\n    return x\n", "def f(a):\n    1 + 2\n    return a\n", "def f():\n    return\n\nf()\n"]
    assert [forms.form(s) for s in odd] == [C.canonical(s) for s in odd]
    n = len(forms.known)
    assert [forms.form(s) for s in sources] == want and len(forms.known) == n


def test_subtrees_of_known_statements_equal_those_of_whole_programs(monkeypatch):
    import random

    rng, known = random.Random(12), {}
    sources = ["".join(f"def f{k}({', '.join(rng.sample('abc', rng.randrange(3)))}):\n{made(rng)}" for k in range(rng.randrange(1, 4))) for _ in range(200)]
    sources += [*SOURCES, None, "def f(:", "class A:\n    @a\n    def f(self):\n        import b as c\n        return c.d\n", "if a:\n    @x\n    def g():\n        y = 1\n", "if a:\n    @z.w\n    def g():\n        y = 1\n"]
    want = [structure.subtree_hashes(s) for s in sources]
    assert [structure.subtree_hashes(s, known) for s in sources] == want
    n = len(known)
    assert [structure.subtree_hashes(s, known) for s in sources] == want and len(known) == n > 0
    monkeypatch.setattr(structure, "KNOWN", 5)
    known.clear()
    assert [structure.subtree_hashes(s, known) for s in sources] == want and len(known) <= 6
