"""Operations on tables: reads, mutations, batch jobs, gateways."""
