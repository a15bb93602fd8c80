"""Array expressions over class probabilities and attributions; all row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def argmax_index(values: Column) -> Column:
    """Zero-based position of the largest value; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def threshold_argmax(prob: Column, thresholds: list[float], labels: list[str]) -> Column:
    """Divide each class by its threshold and take the best class."""
    scaled = F.zip_with(prob, literal_array([float(t) for t in thresholds]), lambda p, t: p / t)
    return F.get(literal_array(labels), argmax_index(scaled))


def runner_up(prob: Column, labels: list[str], minimum: float) -> Column:
    """(label, probability) of the second best class, null unless above ``minimum``.

    Ties keep label order, as a stable descending sort would.
    """
    pairs = F.transform(prob, lambda p, i: F.struct((-p).alias("neg"), i.alias("pos")))
    second = F.get(F.array_sort(pairs), F.lit(1))
    chosen = F.struct(
        F.get(literal_array(labels), second["pos"]).alias("label"), (-second["neg"]).alias("probability")
    )
    return F.when(-second["neg"] > minimum, chosen)


def mean_arrays(arrays: list[Column]) -> Column:
    """Element-wise mean of equally long arrays."""
    total = arrays[0]
    for other in arrays[1:]:
        total = F.zip_with(total, other, lambda a, b: a + b)
    return F.transform(total, lambda v: v / F.lit(float(len(arrays))))


def reorder(prob: Column, from_labels: list[str], to_labels: list[str]) -> Column:
    """Bring a probability array into another label order before it is combined."""
    return F.array(*[F.get(prob, F.lit(from_labels.index(label))) for label in to_labels])


def cascade(attack: Column, conditional: Column, labels: list[str], benign: str = "Benign") -> Column:
    """Compose P(attack) and P(class | attack) into one distribution over ``labels``.

    ``conditional`` holds the attack classes in the order they have in ``labels``.
    """
    out, seen = [], 0
    for label in labels:
        if label == benign:
            out.append(F.lit(1.0) - attack)
        else:
            out.append(attack * F.get(conditional, F.lit(seen)))
            seen += 1
    return F.array(*out)


def top_by_magnitude(items: Column, field: str, k: int) -> Column:
    """The ``k`` structs with the largest absolute ``field``; ties keep the earlier element."""
    keyed = F.transform(items, lambda e, i: F.struct((-F.abs(e[field])).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["e"])
