"""Canonical forms of Python source: rewritten until nothing more changes, so that programs which say the same in another way
are one text.

Rules: names are numbered as they occur; annotations and docstrings go; dead code goes; ``x += e`` is ``x = x + e``; a loop over a
range is a while loop; comparisons point one way and a negation moves into them; of an ``if`` with a negated condition (``<=``
is one, of ``<``) the branches change places; operands of commutative operators, of ``and`` and ``or``, and sides of equalities stand in the order
of their shapes (so text that is joined with ``+`` counts as commutative); sums of whole numbers are worked out. The text is for
comparing; it is never run.
"""

from __future__ import annotations

import ast
import re
from itertools import islice
from textwrap import indent

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import setjoin, structure
from tessella.operators.dependence import drop_unread, live_body, without_dead_code
from tessella.session import written

#: More rounds than any source should need; each is linear.
ROUNDS = 20
_COMMUTATIVE = (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor)
_TURNED = {ast.Gt: ast.Lt, ast.GtE: ast.LtE}
_NEGATED = {ast.Lt: ast.GtE, ast.LtE: ast.Gt, ast.Gt: ast.LtE, ast.GtE: ast.Lt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.In: ast.NotIn, ast.NotIn: ast.In}


def shape(n: ast.AST) -> str:
    """What an expression looks like, whatever its names are called."""
    if isinstance(n, ast.Name):
        return "~"  # after constants and calls
    if isinstance(n, ast.Constant):
        return f"0{type(n.value).__name__}{n.value!r}"
    return f"{type(n).__name__}({','.join(shape(c) for c in ast.iter_child_nodes(n))}{getattr(n, 'attr', '')})"


def order(n: ast.AST) -> tuple:
    """By shape, then by names, which are numbered from the first round on."""
    return shape(n), [(len(x.id), x.id) for x in ast.walk(n) if isinstance(x, ast.Name)]


class _Rewriter(ast.NodeTransformer):
    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        if not isinstance(node.op, _COMMUTATIVE):
            return node
        parts, todo = [], [node]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.BinOp) and type(n.op) is type(node.op):
                todo += [n.right, n.left]
            else:
                parts.append(n)
        if isinstance(node.op, (ast.Add, ast.Mult)):
            whole = [p for p in parts if isinstance(p, ast.Constant) and type(p.value) is int and abs(p.value) < 10**9]
            if len(whole) > 1:
                total = 0 if isinstance(node.op, ast.Add) else 1
                for p in whole[:8]:
                    total = total + p.value if isinstance(node.op, ast.Add) else total * p.value
                parts = [p for p in parts if p not in whole[:8]] + [ast.Constant(total)]
        parts.sort(key=order)
        out = parts[0]
        for p in parts[1:]:
            out = ast.BinOp(out, node.op, p)
        return out

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.AST:
        self.generic_visit(node)
        flat = [x for v in node.values for x in (v.values if isinstance(v, ast.BoolOp) and type(v.op) is type(node.op) else [v])]
        node.values = sorted(flat, key=order)
        return node

    def visit_Compare(self, node: ast.Compare) -> ast.AST:
        self.generic_visit(node)
        if len(node.ops) > 1:
            return node
        op, a, b = node.ops[0], node.left, node.comparators[0]
        if type(op) in _TURNED:
            return ast.Compare(b, [_TURNED[type(op)]()], [a])
        if isinstance(op, (ast.Eq, ast.NotEq)) and order(b) < order(a):
            return ast.Compare(b, [op], [a])
        return node

    def visit_UnaryOp(self, node: ast.UnaryOp) -> ast.AST:
        self.generic_visit(node)
        inner = node.operand
        if isinstance(node.op, ast.Not):
            if isinstance(inner, ast.UnaryOp) and isinstance(inner.op, ast.Not):
                return inner.operand
            if isinstance(inner, ast.Compare) and len(inner.ops) == 1:
                return ast.Compare(inner.left, [_NEGATED[type(inner.ops[0])]()], inner.comparators)
        return node

    def visit_AugAssign(self, node: ast.AugAssign) -> ast.AST:
        self.generic_visit(node)
        if not isinstance(node.target, ast.Name):
            return node
        return ast.Assign([node.target], ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value))

    def visit_AnnAssign(self, node: ast.AnnAssign) -> ast.AST | None:
        self.generic_visit(node)
        return ast.Assign([node.target], node.value) if node.value else ast.Pass()

    def visit_arg(self, node: ast.arg) -> ast.AST:
        node.annotation = None
        return node

    def _function(self, node):
        self.generic_visit(node)
        node.returns = None
        if len(node.body) > 1 and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant):
            node.body = node.body[1:]
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_If(self, node: ast.If) -> ast.AST:
        self.generic_visit(node)
        test = node.test
        if node.orelse and isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            node.test, node.body, node.orelse = test.operand, node.orelse, node.body
        elif node.orelse and isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.NotEq, ast.IsNot, ast.NotIn, ast.LtE)):
            other = ast.Compare(test.left, [_NEGATED[type(test.ops[0])]()], test.comparators)
            node.test, node.body, node.orelse = self.visit_Compare(other), node.orelse, node.body
        return node

    def visit_For(self, node: ast.For) -> ast.AST | list[ast.AST]:
        self.generic_visit(node)
        call = node.iter
        if not (isinstance(node.target, ast.Name) and isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "range" and len(call.args) in (1, 2) and not call.keywords and not node.orelse):
            return node
        inside = [n for b in node.body for n in ast.walk(b)]
        if any(isinstance(n, (ast.Continue, ast.Break)) or isinstance(n, ast.Name) and n.id == node.target.id and isinstance(n.ctx, ast.Store) for n in inside):
            return node
        i, start, stop = node.target.id, *(call.args if len(call.args) == 2 else (ast.Constant(0), call.args[0]))
        end = f"{i}_end"
        load, store = (lambda x: ast.Name(x, ast.Load())), (lambda x: ast.Name(x, ast.Store()))
        again = ast.Assign([store(i)], ast.BinOp(load(i), ast.Add(), ast.Constant(1)))
        return [ast.Assign([store(i)], start), ast.Assign([store(end)], stop), ast.While(ast.Compare(load(i), [ast.Lt()], [load(end)]), [*node.body, again], [])]


def _numbered(tree: ast.AST) -> None:
    """Names that the source itself binds, numbered in order of occurrence."""
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    names: dict[str, str] = {}

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.Name) and n.id in bound:
            n.id = names.setdefault(n.id, f"v{len(names)}")
        elif isinstance(n, ast.arg):
            n.arg = names.setdefault(n.arg, f"v{len(names)}")
        for c in ast.iter_child_nodes(n):
            visit(c)

    visit(tree)


def canonical(source: str | None) -> str | None:
    """The canonical form; null for what does not parse."""
    text = without_dead_code(source)
    for _ in range(ROUNDS):
        tree = structure.parsed(text)
        if tree is None:
            return None
        try:
            tree = ast.fix_missing_locations(_Rewriter().visit(tree))
            _numbered(tree)
            after = ast.unparse(tree)
        except (RecursionError, ValueError):
            return None
        if after == text:
            live = without_dead_code(text)
            if live == text:
                return text
            after = live
        text = after
    return text


#: Statements whose forms are kept, and the nodes of one; beyond the first all are forgotten.
KNOWN, NODES = 1 << 16, 500
_NAME = re.compile(r"(?<![\w.])[^\W\d]\w*")
_SIMPLE = (
    ast.Assign, ast.AugAssign, ast.Expr, ast.If, ast.While, ast.For, ast.Return, ast.Pass, ast.Break, ast.Continue, ast.Name, ast.Constant, ast.BinOp, ast.BoolOp,
    ast.UnaryOp, ast.Compare, ast.Call, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop,
)


class Forms:
    """``canonical`` of sources that are plain functions of simple statements, from what is known of each statement by its
    text; others are left to ``canonical``. A program has thousands of statements, of which most are alike."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def _once(self, make, *key):
        at = (make.__name__, *key)
        if at not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[at] = make(*key)
        return self.known[at]

    @staticmethod
    def _statement(text: str) -> ast.stmt:
        """As it stands in a function."""
        return ast.parse("def f():\n" + indent(text, "    ")).body[0].body[0]

    @staticmethod
    def _texts(body: list[ast.stmt]) -> list[str]:
        for s in body:
            for n in ast.walk(s):
                if isinstance(below := getattr(n, "body", None), list) and not below:
                    n.body = [ast.Pass()]
        return [ast.unparse(ast.fix_missing_locations(s)) for s in body]

    def _live(self, text: str) -> tuple[list[str], bool]:
        """What is reached of a statement, and whether nothing after it is."""
        body = live_body([self._statement(text)])
        return self._texts(body), bool(body) and isinstance(body[-1], (ast.Return, ast.Raise, ast.Break, ast.Continue))

    def _names(self, text: str) -> tuple[frozenset, frozenset, frozenset, tuple]:
        """Names that a statement reads, that it stores, that plain assignments in it may store for nothing, and all in order."""
        order: dict[str, None] = {}

        def visit(n: ast.AST) -> None:
            if isinstance(n, ast.Name):
                order[n.id] = None
            for c in ast.iter_child_nodes(n):
                visit(c)

        s = self._statement(text)
        visit(s)
        names = [n for n in ast.walk(s) if isinstance(n, ast.Name)]
        plain = {t.id for n in ast.walk(s) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        stored = frozenset(n.id for n in names if isinstance(n.ctx, ast.Store))
        return frozenset(n.id for n in names if not isinstance(n.ctx, ast.Store)), stored, frozenset(plain), tuple(order)

    def _read(self, text: str, unread: frozenset) -> tuple[list[str], bool]:
        """A statement without plain assignments to the names that nothing reads, and whether there was one."""
        f = ast.FunctionDef("f", None, [self._statement(text)])
        found = drop_unread(f, lambda name: name not in unread)
        return ([] if len(f.body) == 1 and isinstance(f.body[0], ast.Pass) and found else self._texts(f.body)), found

    def _rewritten(self, text: str) -> list[str]:
        s = _Rewriter().visit(self._statement(text))
        return [ast.unparse(ast.fix_missing_locations(x)) for x in (s if isinstance(s, list) else [s])]

    def _renamed(self, text: str, names: tuple[tuple[str, str], ...]) -> str:
        to = dict(names)
        return _NAME.sub(lambda m: to.get(m[0], m[0]), text)

    def _dead(self, body: list[str]) -> list[str]:
        out: list[str] = []
        for text in body:
            kept, ends = self._once(self._live, text)
            out += kept
            if ends:
                break
        found = True
        while found:
            read = frozenset().union(*(self._once(self._names, x)[0] for x in set(out)))
            gone = {x: g for x in set(out) if (g := self._once(self._names, x)[2] - read)}
            kept, found = [], False
            for text in out:
                if text in gone:
                    after, some = self._once(self._read, text, gone[text])
                    kept += after
                    found |= some
                else:
                    kept.append(text)
            out = kept
        return out or ["pass"]

    @staticmethod
    def _plain(s: ast.stmt) -> str | None:
        """A simple statement's text as it is written back, else None."""
        nodes = list(islice(ast.walk(s), NODES + 1))
        if len(nodes) > NODES or not all(isinstance(n, _SIMPLE) for n in nodes):
            return None
        odd = (isinstance(n, ast.Constant) and type(n.value) not in (int, bool) or isinstance(n, ast.Expr) and not isinstance(n.value, ast.Call) or isinstance(n, ast.Call) and n.keywords for n in nodes)
        return None if any(odd) else ast.unparse(s)

    def _functions(self, source: str) -> list[tuple[str, list[str], list[str]]] | None:
        """(name, arguments, statements) of each function, or None if there is anything else."""
        tree = structure.parsed(source)
        lines, out = structure.source_lines(source), []
        for f in tree.body if tree is not None else ():
            a = getattr(f, "args", None)
            if not isinstance(f, ast.FunctionDef) or f.decorator_list or f.returns or getattr(f, "type_params", None) or a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults or any(x.annotation for x in a.args):
                return None
            body = []
            for s in f.body:
                at = "plain", structure.segment(lines, s)
                if at not in self.known:
                    if len(self.known) >= KNOWN:
                        self.known.clear()
                    self.known[at] = self._plain(s)
                body.append(self.known[at])
            if None in body:
                return None
            out.append((f.name, [x.arg for x in a.args], body))
        return out or None

    def form(self, source: str | None) -> str | None:
        found = self._functions(source) if source else None
        if found is None:
            return canonical(source)
        now = [(f, args, self._dead(body)) for f, args, body in found]
        for _ in range(ROUNDS):
            after = [(f, args, [x for text in body for x in self._once(self._rewritten, text)]) for f, args, body in now]
            bound = {x for _, args, _ in after for x in args}.union(*(self._once(self._names, x)[1] for _, _, body in after for x in set(body)))
            to: dict[str, str] = {}

            def renamed(name: str) -> str:
                return to.setdefault(name, f"v{len(to)}")  # noqa: B023

            again = []
            for f, args, body in after:
                args, out = [renamed(x) for x in args], []
                for text in body:
                    own = tuple((x, renamed(x)) for x in self._once(self._names, text)[3] if x in bound)
                    out.append(self._once(self._renamed, text, own))
                again.append((f, args, out))
            if again == now:
                again = [(f, args, self._dead(body)) for f, args, body in now]
                if again == now:
                    break
            now = again
        return "\n\n".join(f"def {f}({', '.join(args)}):\n" + indent("\n".join(body), "    ") for f, args, body in now)


def canonical_code(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(Forms().form)

    return run(source)


def canonical_scores(pairs: DataFrame, programs: DataFrame) -> DataFrame:
    """id_a, id_b, equal (one canonical form), score (multiset Jaccard of its subtrees), for programs (id, code)."""
    forms = written(programs.select("id", canonical_code(F.col("code")).alias("form")), "canonical")
    digest = forms.select("id", F.xxhash64("form").alias("d"), F.col("form").isNotNull().alias("ok"))
    scores = setjoin.pair_counts(pairs, written(structure.hashed(forms.select("id", F.col("form").alias("code")), structure.subtree_hashes), "subtrees"))
    out = scores.join(digest.toDF("id_a", "da", "oa"), "id_a").join(digest.toDF("id_b", "db", "ob"), "id_b")
    return out.select("id_a", "id_b", (F.col("oa") & F.col("ob") & (F.col("da") == F.col("db"))).alias("equal"), setjoin.multiset_jaccard().alias("score"))
