"""From two states, or a contract, to weights and a nomination bundle.

``python -m locushift.plans.navigate --emb-a A --emb-b B [--out F] [--bundle D]`` or ``--contract C --assembly X --model M --bundle D``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, evaluate, gates, intervals, nominate, score, stats
from ..sources import readers, writers

FEW_ANCHORS = 20


def weights_from_states(spark: SparkSession, path_a: str, path_b: str, norm: str = "rank", direction: str = "auto", direction_norm: str = "maxabs") -> tuple[DataFrame, dict]:
    """Weights from two artifacts. direction: "on" (a signal is required), "off", or "auto" (if both states have one);
    direction_norm: maxabs, raw or signed-rank."""
    (a, meta_a), (b, meta_b) = readers.artifact(spark, path_a), readers.artifact(spark, path_b)
    align.check_states(meta_a, meta_b)
    signal = bool(meta_a.get("has_signal", True)) and bool(meta_b.get("has_signal", True))
    if direction == "on" and not signal:
        raise SystemExit("a direction needs a signal in both states")
    both = align.require_shared(align.aligned(a, b, signal).cache())
    scored = score.driver_score(both, "shift", norm)
    own = direction != "off" and signal
    scored = score.direction(scored, "delta", direction_norm) if own else scored.withColumn("direction", F.lit(None).cast("double"))
    meta = {"assembly": meta_a.get("assembly"), "model": meta_a.get("model"), "source": meta_a.get("source"), "state_a": meta_a.get("cell_state"), "state_b": meta_b.get("cell_state")}
    return scored, meta | {"direction_norm": direction_norm if own else None}


def gate2_frame(weights: DataFrame, positives: DataFrame, signed: DataFrame) -> DataFrame:
    labelled = intervals.overlap_flag(weights, positives)
    return align.attach_value(labelled, signed, name="signed")


def run_gates(spark: SparkSession, weights: DataFrame, matrix: DataFrame | None, anchors: DataFrame | None, signed: DataFrame | None, model: str, anchor_set: str | None = None, **how) -> tuple[dict | None, dict | None]:
    """Both gates' blocks; None for one whose inputs are missing."""
    gate1 = gates.admissibility(matrix).as_dict() if matrix is not None else None
    if gate1 and gate1["universe_truncated"]:
        print(f"note: Gate 1 saw {gate1['universe_n']} regions, fewer than {gates.UNIVERSE}; its figures do not compare with other transitions'")
    if anchors is None or signed is None:
        return gate1, None
    frame = gate2_frame(weights, anchors, signed).cache()
    chosen = gates.select_score(evaluate.against_baseline(frame, **how), model).as_dict()
    # Anchors are the universe's regions with a label; the fold is over all regions, not over the opening ones alone.
    n = frame.where("label").count()
    if n < FEW_ANCHORS:
        print(f"note: {n} anchors lie in the universe, fewer than {FEW_ANCHORS}; Gate 2 has little power")
    fold = stats.fold_enrichment(frame, "driver_score", 0.05).first()[0]
    frame.unpersist()
    rest = {k: chosen[k] for k in ("delta_auroc", "delta_auroc_ci", "lr_p", "lr_coef")}
    return gate1, {"primary": chosen["primary"], "anchor_set": anchor_set, "n_anchors": n, **rest, "fold_enrichment_top5pct": fold, "reason": chosen["reason"]}


def manifest(weights: DataFrame, transition: dict, meta: dict, gate1: dict | None, gate2: dict | None, block: dict) -> dict:
    """The bundle's manifest; numbers are rounded to four places, but for p values."""
    rounded = lambda x, k=None: round(x, 4) if isinstance(x, float) and k != "lr_p" else {i: rounded(v, i) for i, v in x.items()} if isinstance(x, dict) else [rounded(v) for v in x] if isinstance(x, list) else x
    n, measured = weights.agg(F.count(F.lit(1)), F.count("direction")).first()
    model = meta.get("model")
    direction = {"provenance": nominate.provenance(model or ""), "source": f"signal of {model}, {meta.get('state_b')} less {meta.get('state_a')}", "norm": meta.get("direction_norm")}
    return rounded({
        "run_id": transition["id"],
        "transition": transition,
        "region_universe": {"n_regions": n, "source": meta.get("source")},
        "gate1": gate1, "gate2": gate2, "nomination": block,
        "direction": direction if measured else dict.fromkeys(direction),
        "models_run": [model],
    })


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("emb-a", "emb-b", "contract", "assembly", "model", "out", "bundle", "matrix", "state-a", "state-b", "signed", "transition"):
        p.add_argument(f"--{name}")
    p.add_argument("--anchors", "--positives", dest="anchors")
    p.add_argument("--all-regions", action="store_true", help="Gate 2 over all regions, not over the opening ones alone")
    p.add_argument("--norm", choices=("rank", "minmax"), default="rank")
    p.add_argument("--direction", choices=("off", "auto", "on"), default="auto")
    p.add_argument("--direction-norm", choices=("maxabs", "raw", "signed-rank"), default="maxabs")
    p.add_argument("--top-frac", type=float, default=nominate.TOP)
    return p


def check(a: argparse.Namespace) -> None:
    if not a.out and not a.bundle:
        raise SystemExit("give --out, --bundle or both")
    if bool(a.contract) == bool(a.emb_a or a.emb_b):
        raise SystemExit("give either two states or a contract")
    if not a.contract and not (a.emb_a and a.emb_b):
        raise SystemExit("give both --emb-a and --emb-b")
    if a.contract and not (a.assembly and a.model):
        raise SystemExit("a contract needs --assembly and --model")
    if a.matrix and not (a.state_a and a.state_b):
        raise SystemExit("--matrix needs --state-a and --state-b")
    if bool(a.anchors) != bool(a.signed):
        raise SystemExit("Gate 2 needs both --anchors and --signed")


def main(argv: list[str] | None = None) -> dict | None:
    a = parser().parse_args(argv)
    check(a)
    spark = SparkSession.builder.appName("navigate").getOrCreate()
    if a.contract:
        weights = readers.contract(spark, a.contract)
        meta = {"assembly": a.assembly, "model": a.model, "state_a": a.state_a, "state_b": a.state_b, "source": f"contract {os.path.basename(a.contract)}", "direction_norm": None}
    else:
        weights, meta = weights_from_states(spark, a.emb_a, a.emb_b, a.norm, a.direction, a.direction_norm)
    weights = weights.select("ord", "chrom", "start_pos", "end_pos", "driver_score", "direction").cache()
    if a.out:
        writers.contract(weights, a.out)
        n, measured = weights.agg(F.count(F.lit(1)), F.count("direction")).first()
        print(f"{a.out}: {n} regions, {measured} with a direction")
    if not a.bundle:
        return None
    matrix = readers.replicates(spark, a.matrix, a.state_a, a.state_b) if a.matrix else None
    anchors = readers.bed(spark, a.anchors) if a.anchors else None
    signed = readers.track(spark, a.signed) if a.signed else None
    gate1, gate2 = run_gates(spark, weights, matrix, anchors, signed, meta.get("model") or "GET", os.path.basename(a.anchors or "") or None, opening=not a.all_regions)
    rows, block = nominate.nominated(weights, gate1, gate2, a.top_frac, a.norm)
    transition = {"id": os.path.basename(os.path.normpath(a.bundle)), "species": nominate.SPECIES.get(meta["assembly"], "unknown"), "assembly": meta["assembly"], "state_a": meta["state_a"], "state_b": meta["state_b"]}
    transition = readers.transition(a.transition, transition) if a.transition else transition
    out = manifest(weights, transition, meta, gate1, gate2, block)
    writers.bundle(a.bundle, out, weights, rows)
    print(writers.report({"refused": block["refusal_reason"]} if block["refused"] else {k: block[k] for k in ("n_nominated", "score_source", "top_frac")}, a.bundle))
    return out


if __name__ == "__main__":
    main()
