from churnlab.streaming.jobs import *  # noqa: F401,F403
