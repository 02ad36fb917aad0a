"""placemetrics: place-and-population measures as Spark DataFrame functions.

Every public function takes DataFrames and returns a DataFrame (or builds a
Column); nothing is evaluated until the caller runs an action.
"""

__version__ = "0.1.0"
