from placemetrics.sources.files import *  # noqa: F401,F403
from placemetrics.sources.mappings import *  # noqa: F401,F403
from placemetrics.sources.points import *  # noqa: F401,F403
from placemetrics.sources.workbooks import *  # noqa: F401,F403
