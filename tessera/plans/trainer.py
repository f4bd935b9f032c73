"""Training loops: one epoch is a few Spark jobs; parameters and optimizer state stay on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..operators import dense, evaluate, layers
from ..operators.construct import cluster, in_degree, normalize
from ..operators.gather import gather, neighbour_sum
from ..operators.parameters import Adam, Convergence, State, gat_parameters, gcn_parameters, halve_every
from .graph import Graph
from .planner import plan_gcn


@dataclass
class Options:
    """Layer sizes and what a run's command line would say. GCN only: activation (tanh or relu) and dropout, which hits
    what every layer but the first sees. initial: parameters of an earlier run, to go on from."""

    sizes: list[int]
    epochs: int = 5
    rate: float = 0.01
    init: str = "xavier"
    norm: str = "in"
    dedup: bool = False
    chunks: int = 1
    target: float = 1.0
    threshold: float = 0.0
    staleness: int = 0
    neighbour_softmax: bool = False
    optimizer: object = None
    activation: str = "tanh"
    dropout: float = 0.0
    seed: int = 0
    halve: int = 0
    initial: list[dict[str, np.ndarray]] | None = None

    def __post_init__(self):
        if self.activation not in ("tanh", "relu"):
            raise ValueError(f"unknown activation {self.activation}")
        if self.dropout and self.activation != "relu":
            raise ValueError("dropout goes with relu: a dropped unit is told by its zero")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout is a share below 1")

    def start(self, fresh: list[dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
        """Copies of the parameters to resume from, else the fresh ones."""
        return [dict(p) for p in self.initial] if self.initial else fresh

    def set_rate(self, optimizer, epoch: int) -> None:
        """Halves the rate after every `halve` epochs; 0 leaves it alone."""
        if self.halve:
            optimizer.rate = halve_every(self._rate(optimizer), epoch, self.halve)

    def _rate(self, optimizer) -> float:
        if not hasattr(optimizer, "first_rate"):
            optimizer.first_rate = optimizer.rate
        return optimizer.first_rate

    def make_optimizer(self):
        return self.optimizer or Adam(self.rate)


@dataclass
class Run:
    """What a run leaves: parameters and one metrics row an epoch."""

    parameters: list[dict[str, np.ndarray]]
    metrics: list[dict] = field(default_factory=list)
    state: State = State.EARLY

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(m[k] for k in ("epoch", "n", "acc", "loss", "ms")) for m in self.metrics], "epoch int, n long, acc double, loss double, ms double")


_LEVEL = StorageLevel.MEMORY_AND_DISK


def split_labels(graph: Graph, chunks: int = 1) -> DataFrame:
    s = evaluate.split(evaluate.chunk_positions(graph.vertices, chunks))
    return graph.vertices.select("vid", "label").join(s.select("vid", "split"), "vid")


class GcnTrainer:
    """Full-graph training of a graph convolution network with any number of layers.

    Cached for the whole run: weighted edges clustered by destination and by source, the gathered features of the first
    layer, labels with their split. An epoch gathers each further layer once forward and once backward, over rows as
    narrow as the planner can make them. A bounded staleness S > 0 takes each epoch's gradient at the parameters of up
    to S epochs ago (epoch modulo S + 1), the deterministic picture of chunks that run ahead; 0 is the synchronous rule."""

    def __init__(self, graph: Graph, options: Options):
        self.graph, self.options = graph, options
        self.plan = plan_gcn(options.sizes)
        edges, own = normalize(graph.vertices, graph.edges, options.norm, options.dedup)
        self.edges = cluster(edges, "src").persist(_LEVEL)
        self.edges_back = cluster(self.edges, "dst").persist(_LEVEL) if len(self.plan) > 1 else self.edges
        self.own = own.persist(_LEVEL)
        self.first = gather(self.edges, graph.features(), self.own, width=options.sizes[0]).persist(_LEVEL)
        self.labels = split_labels(graph, options.chunks).persist(_LEVEL)
        self.n = graph.vertices.count()
        self._held: list[DataFrame] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(_LEVEL))
        return df

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held = []

    def close(self) -> None:
        self.release()
        for df in (self.edges, self.edges_back, self.own, self.first, self.labels):
            df.unpersist()

    def forward(self, w: list[np.ndarray], key: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
        """(logits (vid, z), frames): frame k has layer k's activation h, what its product saw (inp, unless that is the
        h before) and, if the next layer is multiplied first, the rows q that it gathers. One Python stage a layer.
        key (the epoch): units are dropped, if any are; without it none are."""
        relu, share, seed = self.options.activation == "relu", 0.0 if key is None else self.options.dropout, self.options.seed
        frames: list[DataFrame] = []
        rows = self.first.select("vid", F.col("feat").alias("inp"))
        for k, layer in enumerate(self.plan):
            if k:
                seen = frames[-1].select("vid", F.col("q" if layer.multiply_first else "h").alias("feat"))
                width = layer.width_out if layer.multiply_first else layer.width_in
                rows = gather(self.edges, seen, self.own, width=width).withColumnRenamed("feat", "z" if layer.multiply_first else "inp")
            last = k + 1 == len(self.plan)
            w_next = None if last or not self.plan[k + 1].multiply_first else w[k + 1]

            def step(x, vid, k=k, w=None if layer.multiply_first else w[k], w_next=w_next, last=last):
                z = x if w is None else x @ w
                if last:
                    return {"z": z}
                h = np.maximum(z, 0) if relu else np.tanh(z)
                if share:
                    h = h * layers.dropout_mask(vid, h.shape[1], share, seed, key, k)
                return {"h": h} if w_next is None else {"h": h, "q": h @ w_next}

            if last and layer.multiply_first:
                return rows.select("vid", "z"), frames
            given = "z" if layer.multiply_first else "inp"
            made = ["z"] if last else ["h"] + ["q"] * (w_next is not None)
            frames.append(self._hold(dense.map_rows(rows, step, [given, "vid"], made, ["vid"] + ["inp"] * (not layer.multiply_first))))
        return frames[-1].select("vid", "z"), frames

    def output(self, logits: DataFrame) -> DataFrame:
        """vid, label, split, p, d: probabilities and the averaged, masked error."""
        rows = logits.join(self.labels, "vid").withColumn("train", (F.col("split") == "train").cast("double"))
        n = self.n

        def step(z, label, train):
            p = layers._softmax(z)
            d = p.copy()
            d[np.arange(len(d)), label.astype(np.int64)] -= 1
            return {"p": p, "d": d * (train / (n * layers.SHARE))[:, None]}

        return dense.map_rows(rows, step, ["z", "label", "train"], ["p", "d"], ["vid", "label", "split"])

    def gradients(self, w: list[np.ndarray], frames: list[DataFrame], out: DataFrame) -> list[np.ndarray]:
        """Gradient of every layer's matrix, as small sums of block products. The lowest two layers share one pass: what
        the first one needs is in the rows that the second one reads."""
        grads: list[np.ndarray] = [None] * len(w)
        relu, share = self.options.activation == "relu", self.options.dropout
        g = out.select("vid", F.col("d").alias("g"))
        for k in range(len(w) - 1, 0, -1):
            layer, below = self.plan[k], frames[k - 1]
            if layer.multiply_first:
                u = gather(self.edges_back, g.withColumnRenamed("g", "feat"), self.own, backward=True, width=layer.width_out)
                u = u.withColumnRenamed("feat", "u")
            else:
                rows = self._hold(frames[k].select("vid", "inp").join(g, "vid"))
                grads[k] = dense.gram_sums(rows, ["inp", "g"], lambda inp, g: {0: (inp, g)})[0]
                back = dense.map_rows(rows, lambda g, w=w[k]: {"feat": g @ w.T}, ["g"], ["feat"], ["vid"])
                u = gather(self.edges_back, back, self.own, backward=True, width=layer.width_in).withColumnRenamed("feat", "u")
            m = w[k] if layer.multiply_first else None

            def lower(u, h, m=m):
                # a unit that is zero, by relu or by dropout, passes nothing on
                return (u if m is None else u @ m.T) * ((h > 0) / (1 - share) if relu else 1 - h * h)

            seen = ["vid", "h"] + ["inp"] * (k == 1)
            rows = below.select(*seen).join(u, "vid")
            if k == 1:
                both = layer.multiply_first

                def pairs(u, h, inp, lower=lower, both=both):
                    return {0: (inp, lower(u, h))} | ({1: (h, u)} if both else {})

                for i, x in dense.gram_sums(rows, ["u", "h", "inp"], pairs).items():
                    grads[i] = x
            else:
                rows = self._hold(rows)
                if layer.multiply_first:
                    grads[k] = dense.gram_sums(rows, ["h", "u"], lambda h, u: {0: (h, u)})[0]
                g = dense.map_rows(rows, lambda u, h, lower=lower: {"g": lower(u, h)}, ["u", "h"], ["g"], ["vid"])
        if len(w) == 1:
            rows = frames[0].select("vid", "inp").join(g, "vid")
            grads[0] = dense.gram_sums(rows, ["inp", "g"], lambda inp, g: {0: (inp, g)})[0]
        return [x if x is not None else np.zeros_like(m) for x, m in zip(grads, w)]

    def epoch(self, w: list[np.ndarray], key: int = 0) -> tuple[list[np.ndarray], dict]:
        """Gradients and the metrics of the validation rows; those see no dropout."""
        logits, frames = self.forward(w, key)
        out = self._hold(self.output(logits))
        m = None if self.options.dropout else evaluate.evaluation(evaluate.score_rows(out)).first()
        grads = self.gradients(w, frames, out)
        self.release()
        return grads, {"n": m["n"], "acc": m["acc"], "loss": m["loss"]} if m else self.evaluate(w)

    def evaluate(self, w: list[np.ndarray], where: str | None = "split = 'val'") -> dict:
        """n, acc and loss of the chosen rows, without dropout: "split = 'test'" for the test mask, None for all."""
        out = self.output(self.forward(w)[0])
        m = evaluate.evaluation(evaluate.score_rows(out), where).first()
        self.release()
        return {"n": m["n"], "acc": m["acc"], "loss": m["loss"]}

    def fit(self, on_epoch: Callable[[dict], None] | None = None) -> Run:
        o = self.options
        run = Run(o.start(gcn_parameters(o.sizes, o.init)))
        optimizer, seen = o.make_optimizer(), Convergence(o.target, o.threshold)
        past: list[list[np.ndarray]] = []
        for epoch in range(o.epochs):
            began = time.perf_counter()
            o.set_rate(optimizer, epoch)
            w = [p["w"] for p in run.parameters]
            past = (past + [w])[-(o.staleness + 1):]
            # once the target is near, everyone runs in step
            lag = min(epoch % (o.staleness + 1), len(past) - 1) if run.state is State.EARLY else 0
            grads, m = self.epoch(past[-1 - lag], epoch)
            for k in range(len(w) - 1, -1, -1):
                run.parameters[k]["w"] = optimizer.step((k, "w"), w[k], grads[k])
            optimizer.end_step()
            run.metrics.append({"epoch": epoch, "ms": (time.perf_counter() - began) * 1000} | m)
            if on_epoch:
                on_epoch(run.metrics[-1])
            run.state = seen.see(m["acc"] or 0.0)
            if run.state is State.DONE:
                break
        return run


class GatTrainer:
    """Full-graph training of the attention model: destination-only leaky scores, no activation between layers, the
    prediction step taken on the gathered rows of the last layer over all vertices.

    As a score belongs to a destination it leaves the sum over its edges: a layer is one unweighted gather forward and
    one back, and everything between them is one pass over the vertices. neighbour_softmax keeps scores on the edges."""

    def __init__(self, graph: Graph, options: Options):
        self.graph, self.options = graph, options
        self.edges = cluster(graph.edges, "src").persist(_LEVEL)
        self.edges_back = self.edges if options.neighbour_softmax else cluster(graph.edges, "dst").persist(_LEVEL)
        self.labels = split_labels(graph, options.chunks).persist(_LEVEL)
        degree = in_degree(graph.vertices, graph.edges, "degree").withColumn("degree", F.col("degree").cast("double"))
        self.known = self.labels.join(degree, "vid").persist(_LEVEL)
        self.features = graph.features().persist(_LEVEL)

    def close(self) -> None:
        for df in (self.edges, self.edges_back, self.labels, self.known, self.features):
            df.unpersist()

    def epoch(self, p: list[dict[str, np.ndarray]]) -> tuple[list[dict[str, np.ndarray]], dict]:
        if self.options.neighbour_softmax:
            return self._weighted_epoch(p)
        sizes, held, top = self.options.sizes, [], len(p) - 1

        def hold(df):
            held.append(df.persist(_LEVEL))
            return df

        def feat(df, name):
            return df.select("vid", F.col(name).alias("feat"))

        # row k of a vertex: z{k}, the sum s{k} of its sources, h{k} what the layer's product saw
        rows = hold(dense.map_rows(self.features, lambda x, w=p[0]["w"]: {"z0": x @ w}, ["feat"], ["z0"], ["vid"]))
        for k, q in enumerate(p):
            near = neighbour_sum(self.edges, feat(rows, f"z{k}"), sizes[k + 1], name=f"s{k}")
            both = rows.join(near, "vid")
            if k == top:
                break

            def forward(z, s, a=q["a_i"], w=p[k + 1]["w"], k=k):
                h = layers.gat_rows(z, s, a)
                return {f"h{k + 1}": h, f"z{k + 1}": h @ w}

            rows = hold(dense.map_rows(both, forward, [f"z{k}", f"s{k}"], [f"h{k + 1}", f"z{k + 1}"], both.columns))

        def predict(z, s, label, a=p[top]["a_i"]):
            probability = layers._softmax(layers.gat_rows(z, s, a))
            g = probability.copy()
            g[np.arange(len(g)), label.astype(np.int64)] -= 1
            return {"p": probability, "g": g, "q": layers.gat_push(z, g, a)}

        both = both.join(self.known, "vid")
        rows = hold(dense.map_rows(both, predict, [f"z{top}", f"s{top}", "label"], ["p", "g", "q"], both.columns))
        m = evaluate.evaluation(evaluate.score_rows(rows.select("label", "split", "p"))).first()
        grads: list[dict[str, np.ndarray]] = [{} for _ in p]
        for k in range(top, -1, -1):
            a = p[k]["a_i"]
            back = neighbour_sum(self.edges_back, feat(rows, "q"), sizes[k + 1], backward=True, name="u")
            rows = rows.join(back, "vid")
            if k:
                keep = ["vid", "degree", "g", f"z{k}", *(f"{c}{i}" for i in range(k) for c in "zs"), *(f"h{i}" for i in range(1, k + 1))]

                def lower(z, s, g, u, z_below, a=a, w=p[k]["w"], a_below=p[k - 1]["a_i"]):
                    atg = layers.gat_rows_backward(z, s, g, u, a)
                    below = atg @ w.T
                    return {"atg": atg, "below": below, "q": layers.gat_push(z_below, below, a_below)}

                rows = hold(dense.map_rows(rows, lower, [f"z{k}", f"s{k}", "g", "u", f"z{k - 1}"], ["atg", "below", "q"], keep))

                def pairs(h, atg, z, g, degree, a=a):
                    return {0: (h, atg), 1: (z, z), 2: (np.ones((len(g), 1)), layers.gat_slopes(z, g, degree, a))}

                got = dense.gram_sums(rows, [f"h{k}", "atg", f"z{k}", "g", "degree"], pairs)
                rows = rows.drop("g").withColumnRenamed("below", "g")
            else:

                def pairs(h, z, s, g, u, degree, a=a):
                    return {0: (h, layers.gat_rows_backward(z, s, g, u, a)), 1: (z, z), 2: (np.ones((len(g), 1)), layers.gat_slopes(z, g, degree, a))}

                got = dense.gram_sums(rows.join(self.features, "vid"), ["feat", "z0", "s0", "g", "u", "degree"], pairs)
            grads[k] = {"w": got[0], "a_i": got[1] @ got[2][0]}
        for df in held:
            df.unpersist()
        return grads, {"n": m["n"], "acc": m["acc"], "loss": m["loss"]}

    def _weighted_epoch(self, p: list[dict[str, np.ndarray]]) -> tuple[list[dict[str, np.ndarray]], dict]:
        """Scores normalized over the edges of a destination differ from edge to edge, so each gather carries them."""
        sizes, held = self.options.sizes, []

        def hold(df):
            held.append(df.persist(_LEVEL))
            return df

        h, state = self.graph.features(), []
        for k, q in enumerate(p):
            z = hold(dense.matmul(h, q["w"]))
            scored, ah = layers.gat_forward(self.edges, z, q["a_i"], sizes[k + 1], self.options.neighbour_softmax)
            state.append((h, z, scored))
            h = hold(ah)
        got = hold(layers.gat_predict(h, self.labels, sizes[-1]))
        m = evaluate.evaluation(evaluate.score_rows(got.join(self.labels.select("vid", "split"), "vid"))).first()
        grad, grads = got.select("vid", "feat"), [None] * len(p)
        for k in range(len(p) - 1, -1, -1):
            h, z, scored = state[k]
            width = sizes[k + 1]
            da = layers.gat_attention_gradient(scored, grad, z, width)
            d_scores = layers.gat_edge_backward(scored, grad, p[k]["a_i"])
            atg = hold(layers.gat_backward(scored, d_scores, grad, z, width))
            rows = h.join(atg.withColumnRenamed("feat", "g"), "vid")
            grads[k] = {"w": dense.collect_matrix(dense.gram(rows, "feat", "g"), p[k]["w"].shape), "a_i": da}
            if k:
                grad = dense.matmul(atg, p[k]["w"], transpose_w=True)
        for df in held:
            df.unpersist()
        return grads, {"n": m["n"], "acc": m["acc"], "loss": m["loss"]}

    def fit(self) -> Run:
        o = self.options
        run = Run(o.start(gat_parameters(o.sizes, o.init)))
        optimizer, seen = o.make_optimizer(), Convergence(o.target, o.threshold)
        for epoch in range(o.epochs):
            began = time.perf_counter()
            o.set_rate(optimizer, epoch)
            grads, m = self.epoch(run.parameters)
            for k in range(len(grads) - 1, -1, -1):
                for name, g in grads[k].items():
                    run.parameters[k][name] = optimizer.step((k, name), run.parameters[k][name], g)
            optimizer.end_step()
            run.metrics.append({"epoch": epoch, "ms": (time.perf_counter() - began) * 1000} | m)
            run.state = seen.see(m["acc"] or 0.0)
            if run.state is State.DONE:
                break
        return run
