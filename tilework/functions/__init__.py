"""Column expressions; all run inside Spark's generated code."""

from tilework.functions.scalars import *  # noqa: F401,F403
