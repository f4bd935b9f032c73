"""Choices that Catalyst can't make because they need linearity."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LayerPlan:
    """width_in, width_out, and whether rows are multiplied before they are gathered."""

    width_in: int
    width_out: int
    multiply_first: bool
    cached_gather: bool

    @property
    def gathered(self) -> int:
        """Elements of a row that crosses an edge, each time."""
        return 0 if self.cached_gather else self.width_out if self.multiply_first else self.width_in


def plan_gcn(sizes: list[int]) -> list[LayerPlan]:
    """(A X) W = A (X W): the narrower of the two is gathered. The first layer's A X does not depend on any parameter: it
    is gathered once, before the first epoch, and needs no gather going back either."""
    out = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out.append(LayerPlan(a, b, multiply_first=k > 0 and b < a, cached_gather=k == 0))
    return out
