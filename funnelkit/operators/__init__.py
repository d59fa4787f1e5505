from funnelkit.operators.lookup import *  # noqa: F401,F403
from funnelkit.operators.member import *  # noqa: F401,F403
from funnelkit.operators.agg import *  # noqa: F401,F403
