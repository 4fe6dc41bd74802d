"""Gradients of the few array operations the embedders need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NORM_FLOOR = 1e-12


class Node:
    """An array with the operation that made it; ``backward`` fills ``grad`` of everything it depends on."""

    __slots__ = ("value", "grad", "links")

    def __init__(self, value: np.ndarray, links: list[tuple["Node", Callable]] = ()):
        self.value = value
        self.grad = None
        self.links = links

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(parent, False) for parent, _ in node.links]
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, pull in node.links:
                step = pull(node.grad)
                parent.grad = step if parent.grad is None else parent.grad + step


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """Sum a gradient back to the shape that was broadcast."""
    while grad.ndim > len(shape):
        grad = grad.sum(axis=0)
    for axis, size in enumerate(shape):
        if size == 1 and grad.shape[axis] != 1:
            grad = grad.sum(axis=axis, keepdims=True)
    return grad


def constant(value) -> Node:
    return Node(np.asarray(value, dtype=np.float64))


def add(a: Node, b: Node) -> Node:
    return Node(a.value + b.value, [(a, lambda g: _fit(g, a.value.shape)), (b, lambda g: _fit(g, b.value.shape))])


def sub(a: Node, b: Node) -> Node:
    return Node(a.value - b.value, [(a, lambda g: _fit(g, a.value.shape)), (b, lambda g: -_fit(g, b.value.shape))])


def mul(a: Node, b: Node) -> Node:
    return Node(
        a.value * b.value,
        [(a, lambda g: _fit(g * b.value, a.value.shape)), (b, lambda g: _fit(g * a.value, b.value.shape))],
    )


def scale(a: Node, factor: float) -> Node:
    return Node(a.value * factor, [(a, lambda g: g * factor)])


def total(nodes: list[Node]) -> Node:
    result = nodes[0]
    for node in nodes[1:]:
        result = add(result, node)
    return result


def matmul(a: Node, b: Node) -> Node:
    return Node(a.value @ b.value, [(a, lambda g: g @ b.value.T), (b, lambda g: a.value.T @ g)])


def cross(a: Node, b: Node) -> Node:
    """a @ b.T"""
    return Node(a.value @ b.value.T, [(a, lambda g: g @ b.value), (b, lambda g: g.T @ a.value)])


def relu(a: Node) -> Node:
    positive = a.value > 0
    return Node(a.value * positive, [(a, lambda g: g * positive)])


def silu(a: Node) -> Node:
    gate = 1.0 / (1.0 + np.exp(-a.value))
    return Node(a.value * gate, [(a, lambda g: g * (gate * (1.0 + a.value * (1.0 - gate))))])


def exp(a: Node) -> Node:
    value = np.exp(a.value)
    return Node(value, [(a, lambda g: g * value)])


def log(a: Node) -> Node:
    return Node(np.log(a.value), [(a, lambda g: g / a.value)])


def rows(table: Node, index: np.ndarray) -> Node:
    def pull(g: np.ndarray) -> np.ndarray:
        grad = np.zeros_like(table.value)
        np.add.at(grad, index, g)
        return grad

    return Node(table.value[index], [(table, pull)])


def concat(nodes: list[Node]) -> Node:
    ends = np.cumsum([0] + [n.value.shape[1] for n in nodes])
    return Node(
        np.concatenate([n.value for n in nodes], axis=1),
        [(n, lambda g, i=i: g[:, ends[i] : ends[i + 1]]) for i, n in enumerate(nodes)],
    )


def unit_rows(a: Node) -> Node:
    length = np.sqrt((a.value * a.value).sum(axis=1, keepdims=True))
    floor = np.maximum(length, NORM_FLOOR)
    unit = a.value / floor

    def pull(g: np.ndarray) -> np.ndarray:
        along = (g * unit).sum(axis=1, keepdims=True) * (length > NORM_FLOOR)
        return (g - unit * along) / floor

    return Node(unit, [(a, pull)])


def row_sum(a: Node) -> Node:
    return Node(a.value.sum(axis=1), [(a, lambda g: np.repeat(g[:, None], a.value.shape[1], axis=1))])


def diagonal(a: Node) -> Node:
    return Node(np.diag(a.value).copy(), [(a, lambda g: np.diag(g))])


def mean(a: Node) -> Node:
    return Node(np.asarray(a.value.mean()), [(a, lambda g: np.full(a.value.shape, g / a.value.size))])


def cross_entropy(logits: Node, labels: np.ndarray) -> Node:
    """Mean negative log-softmax of the labelled column."""
    shifted = logits.value - logits.value.max(axis=1, keepdims=True)
    weights = np.exp(shifted)
    sums = weights.sum(axis=1, keepdims=True)
    n = np.arange(len(labels))

    def pull(g: np.ndarray) -> np.ndarray:
        grad = weights / sums
        grad[n, labels] -= 1.0
        return grad * (g / len(labels))

    return Node(np.asarray((np.log(sums[:, 0]) - shifted[n, labels]).mean()), [(logits, pull)])
