"""Factory-floor analytics on Spark.

Machine status history, maintenance work orders and employees in; current
status, uptime, incidents, work-order reports, alerts, KPIs, gold tables and
streaming snapshots out.  Every function takes DataFrames and an explicit
``as_of`` time and returns a DataFrame.
"""
