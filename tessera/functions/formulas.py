"""Closed formulas as columns; an unavailable value is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divided(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def lr_multiplier(step: Column, max_steps: int, warmup_steps: int, warmdown_ratio: float, final_fraction: float) -> Column:
    """Linear warm-up, constant, then linear warm-down to a floor; steps beyond the last stay there."""
    down = round(warmdown_ratio * max_steps)
    at = F.least(step, F.lit(max_steps))
    left = (max_steps - at) / F.lit(float(max(down, 1)))
    out = F.lit(1.0) if not down else F.when(at <= max_steps - down, 1.0).otherwise(left + (1 - left) * final_fraction)
    return F.when(at < warmup_steps, (at + 1) / F.lit(float(warmup_steps))).otherwise(out) if warmup_steps else out


def grad_accum_steps(total_tokens: Column, batch: Column, length: Column, world: Column) -> Column:
    """Micro-steps of an optimizer step; null unless they divide it exactly."""
    per = batch * length * world
    return F.when((per > 0) & (total_tokens % per == 0), F.expr("1") * (total_tokens / per)).cast("long")


def executed_weights(layers: Column, width: Column, mlp: Column, vocab: Column) -> Column:
    return layers * (4 + 2 * mlp) * width * width + width * vocab


def training_flops(layers: Column, width: Column, mlp: Column, vocab: Column, length: Column) -> Column:
    """Forward and backward matrix products a token: six a weight, and attention."""
    return 6 * executed_weights(layers, width, mlp, vocab) + 12 * layers * width * length


def utilisation(flops: Column, seconds: Column, peak: Column) -> Column:
    """Share of the stated peak; null without a peak."""
    return divided(flops, seconds * peak)


def model_size(layers: Column, width: Column, mlp: Column, vocab: Column, length: Column, bias: Column, tied: Column) -> dict[str, Column]:
    """Parameters by part, and of all."""
    flag = bias.cast("int")
    block = (4 + 2 * mlp) * width * width + 2 * width + flag * (mlp + 7) * width
    parts = {"token_embedding": vocab * width, "position_embedding": length * width, "blocks": layers * block, "final_norm": (1 + flag) * width, "output_head": F.when(tied, 0).otherwise(vocab * width)}
    total = parts["token_embedding"] + parts["position_embedding"] + parts["blocks"] + parts["final_norm"] + parts["output_head"]
    return {k: v.cast("long") for k, v in (parts | {"parameters": total}).items()}


def training_memory(parameters: Column, batch: Column, length: Column, width: Column, layers: Column, vocab: Column, element_bytes: int = 4) -> dict[str, Column]:
    """Bytes of weights, gradients, two moments and activations, with a fifth of headroom, at least 512 MiB; exact decimals."""
    big = lambda c: c.cast("decimal(38,0)")
    weights = big(parameters) * element_bytes
    activations = big(batch) * big(length) * (big(width) * big(layers) * 16 + big(vocab) * 2) * element_bytes
    used = weights * 4 + activations
    head = F.greatest(F.ceil(used / 5), F.lit(512 * 1024 * 1024))
    return {"weight_bytes": weights.cast("long"), "gradient_bytes": weights.cast("long"), "optimizer_bytes": (weights * 2).cast("long"), "activation_bytes": activations.cast("long"), "headroom_bytes": head.cast("long"), "total_bytes": (used + head).cast("long")}


def decode_flops(layers: Column, width: Column, mlp: Column, vocab: Column, prompt: Column, steps: Column, cached: Column) -> Column:
    """Products of all decode steps after the first forward pass: with a cache one query a step, else all before it."""
    weights = executed_weights(layers, width, mlp, vocab)

    def step(acc: Column, i: Column) -> Column:
        query = F.when(cached, F.lit(1).cast("long")).otherwise(prompt + i)
        return acc + 2 * weights * query + 4 * layers * width * query * (prompt + i)

    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("long"), step)


def generation_metrics(sampled: Column, seconds: Column, first_seconds: Column) -> dict[str, Column]:
    """Prefill, seconds a decoded token after the first, and tokens a second."""
    first = F.coalesce(first_seconds, F.when(sampled > 0, seconds))
    return {
        "prefill_seconds": first,
        "decode_seconds": F.when(sampled > 1, F.greatest(seconds - first, F.lit(0.0)) / (sampled - 1)),
        "tokens_per_second": F.when((sampled > 0) & (seconds > 0), sampled / seconds),
    }


def eval_steps(tokens: Column, batch: Column, length: Column, world: Column) -> Column:
    """Whole evaluation steps that a token budget pays for."""
    return F.floor(tokens / (batch * length * world)).cast("long")


def token_budget(batch: Column, length: Column, world: Column, accumulation: Column) -> dict[str, Column]:
    micro = batch * length * world
    return {"micro_step_tokens": micro.cast("long"), "optimizer_step_tokens": (micro * accumulation).cast("long")}


def centered(accuracy: Column, baseline: Column) -> Column:
    """Accuracy above chance, over what chance leaves; not clipped."""
    return (accuracy - baseline) / (1 - baseline)
