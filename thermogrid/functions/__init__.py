"""Column functions: every one is a plain Spark expression that stays inside code generation."""

from thermogrid.functions.numeric import *  # noqa: F401,F403
from thermogrid.functions.heat import *  # noqa: F401,F403
from thermogrid.functions.air import *  # noqa: F401,F403
from thermogrid.functions.vegetation import *  # noqa: F401,F403
from thermogrid.functions.indices import *  # noqa: F401,F403
from thermogrid.functions.geo import *  # noqa: F401,F403
from thermogrid.functions.text import *  # noqa: F401,F403
from thermogrid.functions.dates import *  # noqa: F401,F403
from thermogrid.functions.risk import *  # noqa: F401,F403
