from placemetrics.operators.distinct import *  # noqa: F401,F403
from placemetrics.operators.distribution import *  # noqa: F401,F403
from placemetrics.operators.joins import *  # noqa: F401,F403
from placemetrics.operators.measures import *  # noqa: F401,F403
from placemetrics.operators.ordering import *  # noqa: F401,F403
from placemetrics.operators.ranking import *  # noqa: F401,F403
from placemetrics.operators.reshape import *  # noqa: F401,F403
