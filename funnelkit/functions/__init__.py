from funnelkit.functions.expr import *  # noqa: F401,F403
from funnelkit.functions.calendar import *  # noqa: F401,F403
