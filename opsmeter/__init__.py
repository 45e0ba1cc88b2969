"""opsmeter: operational analytics as Spark jobs.

Three families of jobs, each a set of functions from DataFrames to DataFrames:

* ``opsmeter.plans.tickets``  - workflow records: cleaning, stage times, SLA, bottlenecks
* ``opsmeter.plans.quality``  - rule checks over two tables, violation log, scorecard
* ``opsmeter.plans.sales``    - star schema views, KPI tables, customer cohorts

``opsmeter.plans.runs`` reads the inputs of a family, runs its jobs and
rewrites its output tables.
"""
