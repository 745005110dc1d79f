"""A slow evaluator over lists of records, for comparison: null is absent, values are ordered across kinds, sorts are stable on the id."""

from functools import cmp_to_key

from facet.functions import expr as X
from facet.plans import logical as P


def rank(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        return 1
    if isinstance(v, (int, float)):
        return 2
    return 3


def order(a, b):
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    return 0 if a == b or a is None else -1 if a < b else 1


def value(e, rec):
    if isinstance(e, X.Lit):
        return e.value
    if isinstance(e, X.Field):
        return rec.get(e.name)
    if isinstance(e, X.Arith):
        a, b = value(e.left, rec), value(e.right, rec)
        if rank(a) != 2 or rank(b) != 2:
            return None
        if e.op == "/":
            if b == 0:
                return None
            if isinstance(a, int) and isinstance(b, int):
                q = abs(a) // abs(b)
                return q if (a < 0) == (b < 0) else -q
            return a / b
        return {"+": a + b, "-": a - b, "*": a * b}[e.op]
    return None


def truth(e, rec):
    if isinstance(e, (X.Lit, X.Field, X.Arith)):
        v = value(e, rec)
        return v if isinstance(v, bool) else None
    if isinstance(e, X.Compare):
        a, b = value(e.left, rec), value(e.right, rec)
        if a is None or b is None:
            return None
        o = order(a, b)
        return {"=": o == 0, "!=": o != 0, "<": o < 0, "<=": o <= 0, ">": o > 0, ">=": o >= 0}[e.op]
    if isinstance(e, X.And):
        t = [truth(x, rec) for x in e.items]
        return False if False in t else None if None in t else True
    if isinstance(e, X.Or):
        t = [truth(x, rec) for x in e.items]
        return True if True in t else None if None in t else False
    if isinstance(e, X.Not):
        t = truth(e.item, rec)
        return None if t is None else not t
    if isinstance(e, X.IsNull):
        return value(e.item, rec) is None
    if isinstance(e, X.IsNotNull):
        return value(e.item, rec) is not None
    if isinstance(e, X.In):
        a = value(e.item, rec)
        if a is None:
            return None
        options = [value(o, rec) for o in e.options]
        if any(o is not None and order(a, o) == 0 for o in options):
            return True
        return None if None in options else False
    raise TypeError(e)


def run(op, data):
    """Rows as (id, record), in order."""
    if isinstance(op, P.Scan):
        return sorted(data[op.collection].items())
    if isinstance(op, P.GetById):
        return [(i, r) for i, r in sorted(data[op.collection].items()) if i == op.id]
    if isinstance(op, P.Filter):
        return [(i, r) for i, r in run(op.input, data) if truth(op.predicate, r) is True]
    if isinstance(op, P.Project):
        return [(i, {f: r.get(f) for f in op.fields}) for i, r in run(op.input, data)]
    if isinstance(op, P.Limit):
        return run(op.input, data)[: op.n]
    if isinstance(op, P.Sort):

        def compare(x, y):
            for k in op.keys:
                a, b = x[1].get(k.field), y[1].get(k.field)
                if (a is None) != (b is None):
                    o = 1 if a is None else -1
                else:
                    o = order(a, b)
                if o:
                    return -o if k.descending else o
            return -1 if x[0] < y[0] else 1

        return sorted(run(op.input, data), key=cmp_to_key(compare))
    if isinstance(op, P.Aggregate):
        groups = {}
        for _, r in run(op.input, data):
            groups.setdefault(tuple(r.get(g) for g in op.group_by), []).append(r)
        if not op.group_by and not groups:
            groups[()] = []
        out = []
        for key in sorted(groups, key=cmp_to_key(lambda a, b: next((o for x, y in zip(a, b) if (o := order(x, y))), 0))):
            rec = dict(zip(op.group_by, key))
            for a in op.aggs:
                v = [r[a.field] for r in groups[key] if r.get(a.field) is not None] if a.field else groups[key]
                n = [float(x) for x in v if rank(x) == 2] if a.field else []
                rec[a.output] = {
                    "count": lambda v=v, n=n: len(v), "sum": lambda v=v, n=n: sum(n) if n else None, "avg": lambda v=v, n=n: sum(n) / len(n) if n else None,
                    "min": lambda v=v, n=n: min(v, key=cmp_to_key(order)) if v else None, "max": lambda v=v, n=n: max(v, key=cmp_to_key(order)) if v else None,
                }[a.kind]()
            out.append(rec)
        return list(enumerate(out))
    raise TypeError(op)
