"""Variable encoders, contrastive objectives and the predictor head.

Methods: ANCHOR contrasts each variable with the mean of the other ones; CLIP, GMC, MCN, SCARF and SUBTAB are
the published alternatives; CONTROL is a predictor on fresh encoders.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from rowloom.models import tape
from rowloom.models.tape import Node

METHODS = ("SCARF", "SUBTAB", "CLIP", "GMC", "MCN", "ANCHOR")
TRANSFER_METHODS = ("CLIP", "GMC", "MCN", "ANCHOR")

# Fixed values of the objectives.
COSINE_TEMPERATURE = 0.07
GMC_TEMPERATURE = 0.1
MCN_MARGIN = 0.001
SCARF_RATE = 0.5
SUBTAB_BLOCKS, SUBTAB_SKIP, SUBTAB_OVERLAP = 4, 1, 0.75


def anchor_count(batch_size: int) -> int:
    return max(2, batch_size // 10)


@dataclass(frozen=True)
class Variable:
    """A feature of the packed row: its kind, where it starts, and its width there.

    ``levels`` is the number of codes of a categorical variable.
    """

    name: str
    kind: str  # dense, txt, cat or num
    start: int
    width: int
    levels: int = 0


@dataclass(frozen=True)
class Design:
    """Everything that fixes the parameter shapes of a method over a set of variables."""

    method: str
    variables: tuple[Variable, ...]
    latent: int
    hidden: int = 128
    phi: tuple[int, ...] = (128, 128)
    anchors: int = 10
    outputs: int = 0  # > 0: a predictor with that many outputs
    shapes: dict = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if self.method not in (*METHODS, "CONTROL"):
            raise ValueError(f"unknown method {self.method!r}; known: {', '.join((*METHODS, 'CONTROL'))}")
        if self.method == "CONTROL" and not self.outputs:
            raise ValueError("CONTROL is a predictor: it has no embedder")
        if self.method != "CONTROL" and len(self.variables) < 2:
            raise ValueError("a contrastive method needs two feature variables or more")
        object.__setattr__(self, "shapes", self._shapes())

    @property
    def width(self) -> int:
        """Output width of the variable encoders."""
        return self.hidden if self.method in ("ANCHOR", "GMC") else self.latent

    def _mlp(self, name: str, sizes: list[int]) -> dict[str, tuple]:
        layers = {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            layers[f"{name}.w{i}"], layers[f"{name}.b{i}"] = (a, b), (b,)
        return layers

    def encoder_shapes(self, prefix: str) -> dict[str, tuple]:
        shapes, d = {}, self.width
        for v in self.variables:
            name = f"{prefix}.{v.name}" if v.kind in ("cat", "num") else f"{prefix}.{v.kind}"
            if v.kind == "cat":
                shapes[f"{name}.table"] = (v.levels, d)
            elif v.kind == "num":
                shapes.update(self._mlp(name, [1, d, d]))
            else:
                layers = self._mlp(name, [v.width, d])
                if any(shapes.get(k, s) != s for k, s in layers.items()):
                    raise ValueError(f"{v.kind} variables share one encoder, so their vectors must have one length")
                shapes.update(layers)
        return shapes

    def blocks(self) -> list[tuple[int, int]]:
        """Variable ranges of SUBTAB."""
        m = len(self.variables)
        few = m < SUBTAB_BLOCKS
        n_blocks = m if few else SUBTAB_BLOCKS
        size = max(1, m // n_blocks)
        lap = 0 if few else int(SUBTAB_OVERLAP * size)
        return [(0, size + lap)] + [(i * size - lap, (i + 1) * size) for i in range(1, n_blocks)]

    def _shapes(self) -> dict[str, tuple]:
        m, d = len(self.variables), self.latent
        shapes = self.encoder_shapes("enc")
        if self.method == "ANCHOR":
            shapes.update(self._mlp("phi", [self.hidden, *self.phi, d]))
        if self.method == "GMC":
            shapes.update(self._mlp("phi", [self.hidden, self.hidden, d]))
        if self.outputs:
            shapes.update(self._mlp("head", [m * d, d, self.outputs]))
            return shapes
        if self.method == "GMC":
            shapes.update(self.encoder_shapes("aux"))
            shapes.update(self._mlp("joint", [m * self.hidden, self.hidden]))
        if self.method in ("CLIP", "ANCHOR"):
            shapes["tau"] = ()
        if self.method == "MCN":
            shapes["anchors"] = (self.anchors, d)
        if self.method == "SCARF":
            shapes.update(self._mlp("project", [m * d, d, d]))
        if self.method == "SUBTAB":
            start, end = self.blocks()[0]
            shapes.update(self._mlp("project", [(end - start) * d, d, d]))
        return shapes

    def parameter_count(self) -> int:
        return sum(math.prod(s) for s in self.shapes.values())

    def initial(self, seed: int = 0) -> np.ndarray:
        """Flat start weights: tables and anchors are standard normal, layers uniform by their input size."""
        rng = np.random.default_rng(seed)
        parts, bound = [], 1.0
        for name, shape in self.shapes.items():
            if name == "tau":
                parts.append(np.array([math.log(COSINE_TEMPERATURE)]))
            elif name == "anchors" or name.endswith(".table"):
                parts.append(rng.standard_normal(math.prod(shape)))
            else:
                if len(shape) == 2:
                    bound = 1.0 / math.sqrt(shape[0])
                parts.append(rng.uniform(-bound, bound, math.prod(shape)))
        return np.concatenate(parts)

    def unpack(self, flat: np.ndarray) -> dict[str, Node]:
        nodes, at = {}, 0
        for name, shape in self.shapes.items():
            size = math.prod(shape)
            nodes[name] = Node(flat[at : at + size].reshape(shape))
            at += size
        return nodes

    def gradient(self, nodes: dict[str, Node]) -> np.ndarray:
        return np.concatenate(
            [(np.zeros(n.value.size) if n.grad is None else np.asarray(n.grad).reshape(-1)) for n in nodes.values()]
        )


def mlp(p: dict[str, Node], name: str, x: Node, activation=tape.relu) -> Node:
    i = 0
    while f"{name}.w{i}" in p:
        if i:
            x = activation(x)
        x = tape.add(tape.matmul(x, p[f"{name}.w{i}"]), p[f"{name}.b{i}"])
        i += 1
    return x


def encode(design: Design, p: dict[str, Node], x: np.ndarray, prefix: str = "enc", only: list[str] | None = None) -> dict[str, Node]:
    """Encoder output per variable for packed rows ``x``."""
    out = {}
    for v in design.variables:
        if only is not None and v.name not in only:
            continue
        cells = x[:, v.start : v.start + v.width]
        if v.kind == "cat":
            out[v.name] = tape.rows(p[f"{prefix}.{v.name}.table"], cells[:, 0].astype(np.int64))
        else:
            name = f"{prefix}.{v.name}" if v.kind == "num" else f"{prefix}.{v.kind}"
            out[v.name] = mlp(p, name, Node(cells))
    return out


def phi(design: Design, p: dict[str, Node], h: Node) -> Node:
    if design.method == "ANCHOR":
        return mlp(p, "phi", h)
    if design.method == "GMC":
        return mlp(p, "phi", h, tape.silu)
    return h


def cosine(p: dict[str, Node], a: Node, b: Node, temperature: float | None = None) -> Node:
    """Pairwise cosine over a fixed temperature, or over the learned one."""
    sims = tape.cross(tape.unit_rows(a), tape.unit_rows(b))
    if temperature is None:
        return tape.mul(sims, tape.exp(tape.scale(p["tau"], -1.0)))
    return tape.scale(sims, 1.0 / temperature)


def own_row_loss(sims: Node) -> Node:
    return tape.cross_entropy(sims, np.arange(len(sims.value)))


def _mean_of(nodes: list[Node]) -> Node:
    return tape.scale(tape.total(nodes), 1.0 / len(nodes))


def _others_loss(p: dict[str, Node], parts: list[Node], temperature: float | None) -> Node:
    """Mean over parts of the cross-entropy of its summed similarities to the other parts."""
    losses = [
        own_row_loss(tape.total([cosine(p, x, y, temperature) for j, y in enumerate(parts) if j != i]))
        for i, x in enumerate(parts)
    ]
    return _mean_of(losses)


def joint(design: Design, p: dict[str, Node], x: np.ndarray, h: dict[str, Node]) -> Node:
    """The row embedding."""
    parts = list(h.values())
    if design.method == "ANCHOR":
        return phi(design, p, _mean_of(parts))
    if design.method == "GMC":
        aux = tape.concat(list(encode(design, p, x, "aux").values()))
        return phi(design, p, mlp(p, "joint", aux))
    if design.method == "SCARF":
        return mlp(p, "project", tape.concat(parts))
    return _mean_of(parts)


def embed(design: Design, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = design.unpack(flat)
    return joint(design, p, x, encode(design, p, x)).value


def contrastive_loss(design: Design, p: dict[str, Node], x: np.ndarray, rng: np.random.Generator | None) -> Node:
    """Loss of one batch; without a generator (evaluation) nothing is corrupted, and SUBTAB takes its first blocks."""
    h = encode(design, p, x)
    parts, n = list(h.values()), len(x)
    if design.method == "CLIP":
        return _others_loss(p, parts, None)
    if design.method == "ANCHOR":
        whole, rest = tape.total(parts), 1.0 / (len(parts) - 1)
        losses = [
            own_row_loss(cosine(p, phi(design, p, v), phi(design, p, tape.scale(tape.sub(whole, v), rest)))) for v in parts
        ]
        return tape.total(losses)
    if design.method == "GMC":
        a = joint(design, p, x, h)
        off = tape.constant(1.0 - np.eye(n))
        both = tape.exp(cosine(p, a, a, GMC_TEMPERATURE))
        losses = []
        for v in parts:
            z = phi(design, p, v)
            near = tape.exp(cosine(p, a, z, GMC_TEMPERATURE))
            far = tape.total([tape.exp(cosine(p, z, z, GMC_TEMPERATURE)), near, both])
            negatives = tape.row_sum(tape.mul(far, off))
            losses.append(tape.mean(tape.sub(tape.log(negatives), tape.log(tape.diagonal(near)))))
        return _mean_of(losses)
    if design.method == "MCN":
        margin = tape.constant(np.eye(n) * MCN_MARGIN)
        pairs = [
            own_row_loss(tape.sub(tape.cross(u, v), margin)) for i, u in enumerate(parts) for j, v in enumerate(parts) if i != j
        ]
        centre, table = _mean_of(parts).value, p["anchors"]
        d2 = (centre * centre).sum(1)[:, None] + (table.value * table.value).sum(1)[None, :] - 2.0 * centre @ table.value.T
        anchor = tape.rows(table, d2.argmin(axis=1))
        pulls = [own_row_loss(tape.sub(tape.cross(v, anchor), margin)) for v in parts]
        return tape.add(tape.scale(tape.total(pairs), 1.0 / len(parts)), _mean_of(pulls))
    if design.method == "SCARF":
        z = mlp(p, "project", tape.concat(parts))
        twin = z
        if rng is not None:
            chosen = set(rng.permutation(len(parts))[: int(SCARF_RATE * len(parts))].tolist())
            mixed = [tape.rows(v, rng.integers(0, n, n)) if i in chosen else v for i, v in enumerate(parts)]
            twin = mlp(p, "project", tape.concat(mixed))
        return own_row_loss(cosine(p, z, twin, 1.0))
    blocks = design.blocks()
    use = len(blocks) if len(parts) < SUBTAB_BLOCKS else len(blocks) - SUBTAB_SKIP
    order = range(len(blocks)) if rng is None else rng.permutation(len(blocks))
    views = [mlp(p, "project", tape.concat(parts[slice(*blocks[i])])) for i in list(order)[:use]]
    gaps = []
    for i, u in enumerate(views):
        for j, v in enumerate(views):
            if i != j:
                gap = tape.sub(u, v)
                gaps.append(tape.mean(tape.mul(gap, gap)))
    distance = tape.scale(tape.total(gaps), 1.0 / len(parts) ** 2)
    return tape.add(_others_loss(p, views, 1.0), distance)


def predict(design: Design, p: dict[str, Node], x: np.ndarray) -> Node:
    parts = [phi(design, p, h) for h in encode(design, p, x).values()]
    return mlp(p, "head", tape.concat(parts))


def prediction_loss(design: Design, p: dict[str, Node], x: np.ndarray, y: np.ndarray) -> Node:
    out = predict(design, p, x)
    if design.outputs > 1:
        return tape.cross_entropy(out, y.astype(np.int64))
    gap = tape.sub(out, tape.constant(y[:, None]))
    return tape.mean(tape.mul(gap, gap))


def transfer_similarity(design: Design, flat: np.ndarray, x: np.ndarray, query: str) -> np.ndarray:
    """Similarity of every row's value of ``query`` (first axis) to every row's other variables (second axis)."""
    if design.method not in TRANSFER_METHODS:
        raise ValueError(f"{design.method} does not impute variables")
    p = design.unpack(flat)
    h = encode(design, p, x)
    candidate = phi(design, p, h[query])
    evidence = [v for name, v in h.items() if name != query]
    if design.method == "ANCHOR":
        return cosine(p, candidate, phi(design, p, _mean_of(evidence))).value
    if design.method == "MCN":
        return sum(tape.cross(candidate, v).value for v in evidence)
    temperature = GMC_TEMPERATURE if design.method == "GMC" else None
    return sum(cosine(p, candidate, phi(design, p, v), temperature).value for v in evidence)
