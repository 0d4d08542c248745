"""Operations reporting over a weekly plan and a log of execution records, on Spark."""
