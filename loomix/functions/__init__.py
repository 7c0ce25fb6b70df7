"""The corpus of scalar functions, each with its native form."""

from ..serve import NativeFunction
from . import notes, parity, scalars, structures

#: The last bits of these may differ between mathematical libraries.
NEAR = {"np_exp": 1e300, "np_log": 1e-12, "math_log10": 1e-12}


def corpus() -> dict[str, NativeFunction]:
    """Every function by name."""
    return {k: v for module in (scalars, parity, structures, notes) for k, v in vars(module).items() if isinstance(v, NativeFunction)}
