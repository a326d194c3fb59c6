"""codeatlas: code-graph and documentation analytics as Spark DataFrame jobs.

Source text goes in; ``files`` / ``elements`` / ``edges`` / ``docs`` tables come out;
every question over them is a lazy DataFrame. All tables carry a leading ``project``
key, so one call answers for a whole corpus of projects.
"""

__version__ = "0.1.0"
