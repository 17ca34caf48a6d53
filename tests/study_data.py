"""Where the tests find the supplied tables.

In a module of its own: with a conftest.py in a sub-folder as well, the name
``conftest`` means a different module at different times of one run.
"""

SF_SMALL = "/root/testdata/sf0.001"
