from churnlab.functions.features import *  # noqa: F401,F403
