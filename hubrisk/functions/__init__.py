"""Column builders (scalar expressions) shared by the operators."""

from hubrisk.functions.exprs import *  # noqa: F401,F403
