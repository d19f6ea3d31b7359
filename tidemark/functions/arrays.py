"""Array arithmetic as SQL text: one row is one window, so nothing shuffles.

Each helper returns a Spark SQL expression string. ``let`` binds a scalar to a
lambda variable: a scalar that is only an alias may be inlined into the lambda
body by the optimizer and then be recomputed for every element.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def total(x: str) -> str:
    return f"aggregate({x}, 0D, (a_, v_) -> a_ + v_)"


def mean(x: str) -> str:
    return f"({total(x)} / size({x}))"


def sum_sq(x: str) -> str:
    return f"aggregate({x}, 0D, (a_, v_) -> a_ + v_ * v_)"


def std_pop(x: str) -> str:
    return let("m_", mean(x),
               f"sqrt(aggregate({x}, 0D, (a_, v_) -> a_ + (v_ - m_) * (v_ - m_)) / size({x}))")


def centre(x: str) -> str:
    return let("m_", mean(x), f"transform({x}, v_ -> v_ - m_)")


def dot(x: str, y: str) -> str:
    return total(f"zip_with({x}, {y}, (p_, q_) -> p_ * q_)")


def lag_dot(x: str, p: str) -> str:
    """Sum of x[i] * x[i + p]."""
    return dot(f"slice({x}, 1, size({x}) - {p})", f"slice({x}, {p} + 1, size({x}) - {p})")


def mean_abs_step(x: str, p: str) -> str:
    """Mean |x[i + p] - x[i]|; 0 when the series is not longer than p."""
    pairs = (f"zip_with(slice({x}, 1, size({x}) - {p}), slice({x}, {p} + 1, size({x}) - {p}), "
             f"(p_, q_) -> abs(q_ - p_))")
    return f"if(size({x}) > {p}, {total(pairs)} / (size({x}) - {p}), 0D)"


def last(x: str) -> str:
    return f"element_at({x}, -1)"
