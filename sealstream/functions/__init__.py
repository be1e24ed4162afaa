from sealstream.functions.columns import *  # noqa: F401,F403
