"""What counts as the same query, and keys of shapes."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.plans import algebra as A
from tidemill.plans.algebra import Agg, Rel, alias, col, fn
from tidemill.plans.keys import Shape, expose_keys, pages, shape
from tidemill.plans.normal import normal

COLUMNS = {"r": ("r_a", "r_b"), "s": ("s_a", "s_b"), "t": ("t_a", "t_b")}
BASE = {n: Shape(c, (frozenset([c[0]]),), 100.0, 16.0) for n, c in COLUMNS.items()}
R, S, T = Rel("r"), Rel("s"), Rel("t")
c = col


def same(a, b):
    return normal(a, COLUMNS).key == normal(b, COLUMNS).key


def test_join_order_and_association():
    p, q = c("r_a").eq(c("s_a")), c("s_b").eq(c("t_b"))
    assert same(R.join(S, p).join(T, q), T.join(S.join(R, c("s_a").eq(c("r_a"))), q))
    assert same(R.join(S, p), A.Product(S, R).where(p))
    assert not same(R.join(S, p), R.join(S, c("r_a").eq(c("s_b"))))


def test_selections_compose():
    p, q = c("r_a") < 3, c("r_b") > 4
    assert same(R.where(p).where(q), R.where(q & p)) and same(R.where(p & p), R.where(p))
    assert same(R.where((p & q) | (p & (c("r_b") < 0))), R.where(p & (q | (c("r_b") < 0))))
    assert not same(R.where(p), R.where(q))


def test_names_do_not_count_but_expressions_do():
    assert same(R.select(x=c("r_a") + c("r_b")), R.select(y=c("r_b") + c("r_a")))
    assert same(R.select(x=c("r_a"), y=c("r_b")).select(z=c("y")), R.select(w=c("r_b")))
    assert not same(R.select(x=c("r_a") - c("r_b")), R.select(x=c("r_b") - c("r_a")))
    assert not same(R.select(x=c("r_a")), R.select(x=c("r_a"), y=c("r_a")))


def test_self_join_and_groups_and_antijoins():
    x, y = alias(R, "x", COLUMNS["r"]), alias(R, "y", COLUMNS["r"])
    assert same(x.join(y, c("x_r_a") < c("y_r_a")), y.join(x, c("x_r_a") < c("y_r_a")))
    p = c("r_a").eq(c("s_a"))
    assert same(R.join(S, p).group((c("r_b"),), n=Agg("count")), S.join(R, p).group((c("r_b"),), m=Agg("sum", A.Lit(1)))) is False
    assert same(R.join(S, p).group((c("r_b"),), n=Agg("count")), S.join(R, p).group((c("r_b"),), m=Agg("count")))
    assert same(A.LeftAnti(p, R, S), A.RightAnti(p, S, R)) and not same(A.LeftAnti(p, R, S), A.LeftAnti(p, S, R))
    assert not same(A.Sort(((c("r_a"), True),), R), A.Sort(((c("r_a"), False),), R))
    assert not same(A.Limit(1, R), A.Drop(1, R))


@settings(deadline=None, max_examples=30)
@given(st.permutations([0, 1, 2, 3]), st.booleans())
def test_any_order_of_conjuncts(order, flip):
    ps = [c("r_a") < 1, c("r_b").eq(2), c("r_a").ne(5), c("r_b").like("x%")]
    q = R
    for i in order:
        q = q.where(ps[i])
    assert same(q, R.where(ps[0] & ps[1] & ps[2] & ps[3]))
    a, b = (c("r_a"), c("r_b")) if flip else (c("r_b"), c("r_a"))
    assert same(R.where(a.eq(b)), R.where(c("r_a").eq(c("r_b"))))


def test_keys_and_sizes():
    fk = R.join(S, c("r_b").eq(c("s_a")))
    s = shape(fk, BASE)
    assert frozenset(["r_a"]) in s.keys and s.rows == 100
    assert round(shape(R.join(S, c("r_b") < c("s_b")), BASE).rows, 6) == round(10000 / 3, 6)
    assert shape(R.where(c("r_a") < 1), BASE).rows == 50
    assert shape(R.select(x=c("r_b")), BASE).keys == ()
    exposed = expose_keys(R.select(x=c("r_b")), BASE)
    assert shape(exposed, BASE).keys == (frozenset(["r_a"]),)
    assert shape(expose_keys(R.group((c("r_b"),), n=Agg("count")), BASE), BASE).keys == (frozenset(["r_b"]),)
    assert pages(0) == 0 and pages(1) == 1 and pages(4097) == 2


def test_inversion():
    for e in (c("x") + 3, 3 and c("x") * 4, -(c("x") - 1), A.lift(7) - c("x"), c("x") / 2):
        back = A.invert(e, "x", A.Lit("e"))
        assert back is not None and A.columns_of(back) == set()
    assert A.invert(c("x") + c("x"), "x", c("y")) is None and A.invert(c("x") * 0, "x", c("y")) is None
    assert A.invert(fn("abs", c("x")), "x", c("y")) is None


def test_clauses_are_distributed_and_negations_pushed_down():
    x, y, z = (col(n).eq(1) for n in "xyz")
    assert set(A.normal_clauses(x | (y & z))) == {x | y, x | z}
    assert set(A.normal_clauses(~(x | ~y))) == {~x, y}
    assert A.normal_clauses(~(x & y)) == [~x | ~y]
    wide = x & y
    for i in range(8):
        wide = wide | (col(f"a{i}").eq(1) & col(f"b{i}").eq(2))
    assert A.normal_clauses(wide) == [wide]  # 512 clauses are too many


def test_equal_terms_in_any_order_have_one_form():
    """Eight uses of a table, of which the conjuncts tell all apart: no order of them has to be tried."""
    columns = {"e": ("e_a", "e_b")}
    uses = [A.alias(Rel("e"), f"u{i}", ["e_a", "e_b"]) for i in range(8)]

    def chain(order):
        q = uses[order[0]]
        for i in order[1:]:
            q = A.Product(q, uses[i])
        p = col("u0_e_a").eq(7)
        for i in range(7):
            p = p & col(f"u{i}_e_b").eq(col(f"u{i + 1}_e_a"))
        return q.where(p).keep("u7_e_b")

    assert normal(chain(list(range(8))), columns).key == normal(chain([3, 7, 1, 0, 6, 2, 5, 4]), columns).key
