"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Workers import it by name, so a cluster job ships the package with ``--py-files`` or installs it.
"""
