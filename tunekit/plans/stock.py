"""The stock operators of chains."""

from __future__ import annotations

import random

from tunekit.operators import select, train
from tunekit.operators.columns import feature_names
from tunekit.operators.prep import Clip, Fill, MinMax, Power, QuantileBuckets, RadialBasis, Standardize
from tunekit.operators.registry import METRIC, SELECTION, STEP, TRAINER, VECTOR, WIDE, Operator, register


def _on(values) -> bool:
    return values[0] >= 1


def _rbf(v, chain):
    return RadialBasis(max(int(v[1]), 2), max(int(v[2]), 1), max(v[3], 0.01), chain.rbf_mode, chain.seed, enabled=_on(v))


def _greedy(rows, values, chain, params, parallelism, gains):
    depth = select.depth_limit(chain.memory, random.Random(f"{chain.seed}/{list(params)}").random())
    found, total, done = select.backward_beam(rows, depth, parallelism=parallelism)
    gains.append((total, done))
    return found


def _trainer(name):
    def build(values, chain):
        extra = {} if name == "lr" else {"seed": chain.seed}
        return train.TRAINERS[name](*values, **extra)

    return build


for step in ("split", "balance", "weigh", "evaluate", "assemble"):
    register(Operator(step, STEP))
register(Operator("fill", WIDE, lambda v, chain: Fill("median" if v[0] == 1 else "mean", chain.rel_error)))
register(Operator("clip", WIDE, lambda v, chain: Clip.from_index(int(v[1]), rel_error=chain.rel_error, enabled=_on(v))))
register(Operator("power", WIDE, lambda v, chain: Power(code=int(v[1]), enabled=_on(v))))
register(Operator("buckets", WIDE, lambda v, chain: QuantileBuckets(max(int(v[1]), 2), chain.rel_error, enabled=_on(v))))
register(Operator("minmax", VECTOR, lambda v, chain: MinMax(enabled=_on(v))))
register(Operator("standardize", VECTOR, lambda v, chain: Standardize(enabled=_on(v))))
register(Operator("rbf", VECTOR, _rbf))
register(Operator("lasso", SELECTION, lambda rows, v, chain: select.lasso(rows, v[0], feature_names(rows))))
register(Operator("greedy", SELECTION, _greedy))
for trainer in train.TRAINERS:
    register(Operator(trainer, TRAINER, _trainer(trainer)))
for metric in ("auc", "ks"):
    register(Operator(metric, METRIC))
