from placemetrics.functions.bins import *  # noqa: F401,F403
from placemetrics.functions.semantics import *  # noqa: F401,F403
from placemetrics.functions.text import *  # noqa: F401,F403
