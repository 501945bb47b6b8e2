"""plumbline: evidence-bound data work expressed as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames. A refusal that stops the
work is a :class:`plumbline.errors.Refusal` with a stable code; anything that can
occur more than once is returned as rows.
"""

from plumbline.errors import Refusal

__all__ = ["Refusal"]
